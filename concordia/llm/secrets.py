"""Operator 10: secret scans; a random forest removes false positives among the candidates."""

from __future__ import annotations

import random
import string
import uuid
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import forest

_RUN = r"[A-Za-z0-9+/_.\-]"
_ASSIGNED = r"(?<=[:=]>?[ \t]{0,3}[\"'`]?)"
_NAMED = r"(?<=(?i:secret|token|passw|pwd|api.?key|access.?key|auth|credential|private.?key|client.?key)[A-Za-z0-9_]{0,12}[\"'`]?\]?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}[\"'`]?)"
_BEARER = r"(?<=(?i:bearer)[ \t]{1,3})"
#: Runs of token characters: 16 or longer with a digit, or 6 or longer after the name of a secret.  "=" only pads.
CANDIDATE = (
    rf"(?<!{_RUN})(?:(?=[A-Za-z+/_.\-]*[0-9]){_RUN}{{16,}}|(?={_RUN}{{6}})(?:{_ASSIGNED}{_NAMED}|{_BEARER}){_RUN}{{6,}})"
    rf"(?:={{1,2}}(?![A-Za-z0-9+/_.=\-]))?"
)
#: Candidates whose lengths are summed together.
BLOCK = 128
#: Characters around a candidate that the features see.
CONTEXT = 60
#: Labelled findings that the forest is fitted on, at most.
TRAINING_ROWS = 4000
#: Words that names and prose in code are made of.
DICTIONARY = (
    "access account address admin api app archive article auth backup bin blog book branch build cache cdn check class client code com commit common config "
    "content core count css data date db default demo dev digest dist doc docs document download draft dummy edit email en error event example export file files "
    "first font form game github group guide hash help home host html http https icon id image images img import index info input item java jpg js json key lang "
    "last lib license line link list live local log login mail main map master media menu meta model module name net new news node number object old org order "
    "package page part password path php placeholder play png port post print private product profile project public query read release report request "
    "resource root run sample script search secret section send server service session set shop site size source spec src staging start state static status "
    "store string style support svg system table tag target task temp test text theme time title token tool tree txt type update upload url user util "
    "utils uuid value version video view web wiki www xml year your zip"
).split()
SECRET_NEAR = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|auth|bearer|credential|private.?key|client.?key)[^\n]{0,16}$"
OTHER_NEAR = r"(?i)(commit|sha-?(1|256)?|md5|digest|checksum|hash|revision|rev|uuid|guid|etag|build|version|isbn|card|phone|order|invoice|example|sample|dummy|test)[^\n]{0,16}$"
PATH_NEAR = r"(?i)(://[^\s]*|www\.[^\s]*|[\\/@#.])$"
FEATURES = (
    "length", "digits", "capitals", "small", "marks", "transitions", "distinct", "hex", "numeric", "dictionary", "in_path", "secret_near",
    "other_near", "assigned", "quoted",
)


def features(value: Column, before: Column, after: Column) -> list[Column]:
    """Doubles, in the order of FEATURES."""
    n = F.char_length(value).cast("double")
    share = lambda kept: F.char_length(F.regexp_replace(value, f"[^{kept}]", "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    known = "(?i)(" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))) + ")"
    flag = lambda c: c.cast("int").cast("double")
    return [
        n,
        share("0-9"),
        share("A-Z"),
        share("a-z"),
        share(r"+/_=.\-"),
        F.char_length(kinds) / n,
        F.size(F.array_distinct(F.split(value, ""))).cast("double"),
        flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        flag(value.rlike(r"^[0-9.+\-]+$")),
        1 - F.char_length(F.regexp_replace(value, known, "")) / n,
        flag(before.rlike(PATH_NEAR) | value.rlike(r"/[A-Za-z_.\-]+/|\.(com|org|net|html?|php|png|jpg|js|json)")),
        flag(before.rlike(SECRET_NEAR)),
        flag(before.rlike(OTHER_NEAR)),
        flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
    ]


def labelled_findings(n: int = 2400, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(before, value, after, is secret): findings labelled by how they are made, half of each.

    Secrets are random tokens in hex, base64 and vendor shapes and passwords after names of
    secrets, also in .env lines and URLs; the rest are hashes, ids, numbers, paths, addresses,
    placeholders, and code and prose after such names, in their usual places.
    """
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    filler = lambda: " ".join(pick(string.ascii_lowercase, rng.randint(2, 9)) for _ in range(rng.randint(0, 6)))
    names = ("token", "TOKEN", "secret", "api_key", "API_KEY", "apiKey", "password", "auth_token", "access_key", "client_secret", "SECRET_KEY", "bearer")
    shapes = (
        lambda: pick(hexes, rng.choice((32, 40, 40, 48, 64))),
        lambda: pick(alnum, rng.randint(20, 64)),
        lambda: pick(alnum + "+/", rng.randint(22, 86)) + rng.choice(("", "=", "==")),
        lambda: rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-", "AKIA")) + pick(alnum, rng.randint(16, 40)),
        lambda: pick(alnum + "_-", rng.randint(24, 44)),
        lambda: pick(string.ascii_letters, rng.randint(16, 32)),
        lambda: pick(string.ascii_lowercase, rng.randint(4, 8)) + pick(string.digits, rng.randint(1, 3)) + pick(string.ascii_letters, rng.randint(1, 4)) + pick(string.digits, rng.randint(0, 2)),
        lambda: pick(alnum, rng.randint(9, 18)),
    )
    words = lambda k, sep: sep.join(rng.choice(DICTIONARY) for _ in range(k))
    others = (
        lambda: (f"{filler()} {rng.choice(('commit', 'sha1:', 'md5 =', 'checksum:', 'revision'))} ", pick(hexes, rng.choice((32, 40, 64))), " "),
        lambda: (f"{filler()} {rng.choice(('uuid:', 'id =', 'guid', ''))} ", str(uuid.UUID(int=rng.getrandbits(128))), " "),
        lambda: (f"{filler()} ", pick(string.digits, rng.randint(16, 19)), rng.choice((" ", ".", ","))),
        lambda: (f"{filler()} https://", f"{words(2, '.')}.com/{words(3, '/')}/{pick(string.digits, 4)}", " "),
        lambda: (f"{filler()} ", f"/{words(3, '/')}/{words(2, '-')}-{rng.randint(1, 99)}.json", " "),
        lambda: (f"{filler()}.{rng.randint(10, 99)}", f"@mail{rng.randint(1, 9)}.example.com".lstrip("@") + f"{rng.randint(100, 999)}", " "),
        lambda: (f'{rng.choice(names)} = "', rng.choice(("your_token_here_123", "example-api-key-0000", "changeme1234567890", "xxxxxxxxxxxxxxxx0000", "test_secret_1234567")), '"'),
        lambda: (f"{filler()} {rng.choice(names)}{rng.choice((': ', ' = ', '='))}", words(rng.randint(1, 3), rng.choice("._")), rng.choice((" ", "(", ")", ",", ";"))),
        lambda: (f"{filler()} {rng.choice(names)}: ", pick(string.ascii_lowercase, rng.randint(6, 11)), rng.choice((" ", ".", ","))),
        lambda: (f"{filler()} ", f"{words(3, '_')}_v{rng.randint(1, 20)}", rng.choice((" ", "(", "="))),
        lambda: (f"{filler()} ", f"20{rng.randint(10, 26)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{rng.randint(10, 23)}-{rng.randint(10, 59)}-00", " "),
    )
    rows = []
    for i in range(n):
        if i % 2:
            q = rng.choice(('"', "'", ""))
            place = rng.choice((f"{filler()} ", f"{filler()} ", "\nexport ", "\n", f"{filler()} https://{words(2, '.')}.com/{words(1, '')}?"))
            sep = rng.choice(("=",) if place[-1] in "?\n" or "export" in place else (" = ", "=", ": ", ": "))
            rows.append((f"{place}{rng.choice(names)}{sep}{'' if '?' in place else q}", rng.choice(shapes)(), "&" if "?" in place else q or rng.choice((" ", "\n")), 1))
        else:
            rows.append((*rng.choice(others)(), 0))
    return rows


def train(spark: SparkSession, findings: DataFrame | None = None, rows: int = TRAINING_ROWS) -> list:
    """A forest from labelled findings (before, value, after, label), of which ``rows`` are used at most:
    those with the least hashes, however the table is dealt out."""
    if findings is None:
        return _built_in(spark)
    table = findings.select("before", "value", "after", "label").orderBy(F.xxhash64("before", "value", "after", "label"), "before", "value", "after").limit(rows)
    shown = table.select(*features(F.col("value"), F.col("before"), F.col("after")), F.col("label").cast("double")).collect()
    data = np.array([list(r) for r in shown], float)
    return forest.fit(data[:, :-1], data[:, -1])


def found_in_texts(spark: SparkSession, rows: list[tuple[str, str, str, int]]) -> DataFrame:
    """(before, value, after, label) of what candidates() finds in the whole texts of labelled findings.

    A candidate other than the finding is no secret; one that only overlaps a secret is left out.
    """
    texts = [(i, b + v + a, len(b), len(v), y) for i, (b, v, a, y) in enumerate(rows)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, at int, size int, is_secret int")
    n = F.char_length("value")
    exact = (F.col("start") == F.col("at")) & (n == F.col("size"))
    apart = (F.col("start") + n <= F.col("at")) | (F.col("start") >= F.col("at") + F.col("size"))
    found = candidates(docs).join(docs.drop("text"), "doc_id").where(exact | apart | (F.col("is_secret") == 0))
    return found.orderBy("doc_id", "finding").select("before", "value", "after", F.when(exact, F.col("is_secret")).otherwise(0).alias("label"))


@cache
def _built_in(spark: SparkSession) -> list:
    return train(spark, found_in_texts(spark, labelled_findings()))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, finding (from 0), start, value, before, after of every candidate of the whole texts."""
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE))
    last = lambda r: F.substring(r, F.greatest(F.char_length(r) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT))
    ends = lambda r: F.struct(
        F.char_length(r).cast("long").alias("n"),
        last(r).alias("last"),
        F.substring(r, F.lit(1), F.lit(CONTEXT)).alias("first"),
    )
    rows = rows.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
        F.transform(F.split("text", CANDIDATE), ends).alias("rest"),
    )
    rows = rows.withColumn("lasts", F.transform("found", last))
    rows = rows.withColumn("sizes", F.zip_with("rest", "found", lambda r, v: r.getField("n") + F.coalesce(F.char_length(v), F.lit(0))))
    # Sums of whole blocks keep the places of many candidates in one text from being summed anew.
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, n: t + n)
    block = F.sequence(F.lit(0), F.floor(F.size("found") / BLOCK).cast("int"))
    rows = rows.withColumn("blocks", F.transform(block, lambda b: total(F.slice("sizes", b * BLOCK + 1, F.lit(BLOCK)))))

    def hit(value: Column, i: Column) -> Column:
        whole = F.floor(i / BLOCK).cast("int")
        start = total(F.slice("blocks", F.lit(1), whole)) + total(F.slice("sizes", whole * BLOCK + 1, i - whole * BLOCK)) + F.get("rest", i).getField("n")
        # The name before a value may be a candidate itself.
        before = F.concat(
            F.coalesce(F.get("rest", i - 1).getField("last"), F.lit("")), F.coalesce(F.get("lasts", i - 1), F.lit("")), F.get("rest", i).getField("last")
        )
        return F.struct(i.alias("finding"), start.alias("start"), value.alias("value"), last(before).alias("before"), F.get("rest", i + 1).getField("first").alias("after"))

    return rows.select("doc_id", F.inline(F.transform("found", hit)))


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, finding, start, length, secret_sha256 and score of each secret.

    Candidates are long runs of token characters with a digit, and shorter or digit-free
    ones after the name of a secret.  The forest scores their
    length, character shares and transitions, dictionary coverage, path and neighbouring
    words; those below ``threshold`` are removed as false positives.  Secrets are given as
    digests, never as texts.

    Null and empty texts have none; texts of any length are searched as a whole; repeated rows
    give repeated findings, a text's findings are numbered by place; a score that equals
    ``threshold`` stands; other columns are ignored; an empty table gives no rows.
    """
    trees = train(docs.sparkSession, findings)
    scored = candidates(docs).select("*", *(c.alias(n) for n, c in zip(FEATURES, features(F.col("value"), F.col("before"), F.col("after")), strict=True)))
    scored = scored.withColumn("score", F.round(forest.column(trees, [F.col(n) for n in FEATURES]), 6))
    return scored.where(F.col("score") >= threshold).select(
        "doc_id",
        F.col("finding").cast("long").alias("finding"),
        "start",
        F.char_length("value").cast("long").alias("length"),
        F.sha2("value", 256).alias("secret_sha256"),
        "score",
    )
