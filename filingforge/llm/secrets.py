"""Secret scans with DataFrame functions alone.

Three base patterns find assignments, access keys and hexadecimal runs. Beside them, every long token, and what base
spans leave of one, is scored by two character Markov models, one of random strings and one of ordinary identifiers: the
sum over its character pairs of the log-likelihood ratio. The models are bigram tables over 65 classes of characters,
counted from labelled samples; of them only those counts, at most 2 * 65 * 65, reach the driver.

Spans are in code points, ends exclusive. Matches are found by splitting the text at the pattern: running sums of the
lengths of gaps and matches are the places. Running sums go by chunks of about the square root of the number of
matches, so a text with very many matches stays feasible.

Defined results: a null text is empty and has no spans; a very long text or token is scanned whole; repeated rows are
scanned each for itself; an empty table gives an empty result; other columns may be carried along under any names but
those of the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingforge.session import spread

#: Fixed patterns, in the order in which spans at one place are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6
#: Stands for each character of a base span while the rest is looked through.
BLANK = "\x1f"
#: Tokens that the models score: long ones, and shorter ones that a base span was cut from.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}={0,2}|(?<=\x1f)[A-Za-z0-9+/_-]{8,}={0,2}|[A-Za-z0-9+/_-]{8,}(?=\x1f))"
#: Classes of characters: this alphabet's, and one for all else.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
CLASSES = len(ALPHABET) + 1
#: Log-likelihood ratio, in thousandths of a nat, from which a token is a secret (recall and false hits at this value are
#: asserted in the tests).
THRESHOLD = 4_000
#: Random strings in the labelled samples, and documents that ordinary ones are drawn from, about.
RANDOM_SAMPLES, ORDINARY_DOCS = 3_000, 1_500
MARK = "[secret]"


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running combinations of an array of longs: as many entries, the i-th over the first i."""
    n = F.size(values)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest((n - 1) / width, F.lit(0)).cast("int")), lambda c: F.slice(values, c * width + 1, width))
    empty = F.array().cast("array<long>")
    inner = F.transform(chunks, lambda chunk: F.aggregate(chunk, empty, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, step(F.try_element_at(acc, F.lit(-1)), x)).otherwise(x)))))
    # (running value before the chunk, its entries), chunk by chunk
    joined = F.aggregate(
        inner,
        F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<array<long>>").alias("out")),
        lambda acc, chunk: F.struct(
            F.when(acc["last"].isNull(), F.try_element_at(chunk, F.lit(-1))).otherwise(step(acc["last"], F.try_element_at(chunk, F.lit(-1)))).alias("last"),
            F.concat(acc["out"], F.array(F.when(acc["last"].isNull(), chunk).otherwise(F.transform(chunk, lambda x: step(acc["last"], x))))).alias("out"),
        ),
    )
    return F.when(n > 0, F.flatten(joined["out"])).otherwise(empty)


SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def places(df: DataFrame, pattern: str, name: str, guard: Column, text: str = "text") -> DataFrame:
    """Adds name_m, the matches of the pattern in the text, and name_e, where each ends (code points)."""
    rx = F.lit(pattern)
    empty = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_m", F.when(guard, F.regexp_extract_all(text, rx, F.lit(0))).otherwise(empty))
    lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f"{name}_m")), F.col(f"{name}_m"), lambda gap, match: (F.length(gap) + F.length(match)).cast("long"))
    return df.withColumn(f"{name}_l", F.when(F.size(f"{name}_m") > 0, lengths).otherwise(F.array().cast("array<long>"))).withColumn(
        f"{name}_e", F.when(F.size(f"{name}_m") > 0, running(F.col(f"{name}_l"), lambda a, b: a + b)).otherwise(F.array().cast("array<long>"))
    )


def spans_of(name: str, kind: str) -> Column:
    """Spans of what places() found."""
    return F.zip_with(
        F.col(f"{name}_m"), F.col(f"{name}_e"), lambda m, e: F.struct((e - F.length(m)).cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.cast("long").alias("end"))
    ).cast(SPAN)


def class_of(char: Column) -> Column:
    """0 to CLASSES - 1."""
    at = F.instr(F.lit(ALPHABET), char)
    return F.when(at > 0, at - 1).otherwise(F.lit(CLASSES - 1)).cast("int")


def pair_codes(token: Column) -> Column:
    """The codes of all pairs of neighbouring characters, in time that grows with the length alone."""
    classes = F.slice(F.transform(F.split(token, ""), class_of), F.lit(1), F.length(token))
    n = F.greatest(F.length(token) - 1, F.lit(0))
    return F.zip_with(F.slice(classes, F.lit(1), n), F.slice(classes, F.lit(2), n), lambda a, b: a * CLASSES + b)


def pair_counts(samples: DataFrame) -> DataFrame:
    """samples: text, random (boolean). Pairs of characters counted: code, random, n."""
    pairs = samples.where(F.length("text") >= 2).select(
        "random", F.explode(pair_codes(F.col("text"))).alias("code")
    )
    return pairs.groupBy("random", "code").agg(F.count("*").alias("n"))


def train_markov(samples: DataFrame) -> list[int]:
    """The log-likelihood ratio, in thousandths of a nat, of each pair code; add-one smoothing."""
    counts = {(r["random"], r["code"]): r["n"] for r in pair_counts(samples).collect()}
    out = []
    totals = {(label, a): sum(counts.get((label, a * CLASSES + b), 0) for b in range(CLASSES)) for label in (True, False) for a in range(CLASSES)}
    for code in range(CLASSES * CLASSES):
        a = code // CLASSES
        p, q = ((counts.get((label, code), 0) + 1) / (totals[label, a] + CLASSES) for label in (True, False))
        out.append(round(1000 * math.log(p / q)))
    return out


def labelled_samples(docs: DataFrame, *, text: str = "text", random_samples: int = RANDOM_SAMPLES, ordinary_docs: int = ORDINARY_DOCS) -> DataFrame:
    """Random strings by rule (base64, URL-safe, hexadecimal and alphanumeric digests of counters) and ordinary identifiers.

    Ordinary ones are words of a sample of documents, alone and joined as identifiers are; the sample's share is set
    from the count of all rows, and it is drawn by the hash of the text. Words with digits are left out.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    packed = F.base64(F.unhex(digest))
    plain, turn = F.regexp_replace(packed, "[^A-Za-z0-9]", ""), F.col("id") % 5
    random = spark.range(random_samples).select(
        F.when(turn == 0, digest).when(turn == 1, F.substring(packed, 1, 40)).when(turn == 2, plain).when(turn == 3, F.upper(plain)).otherwise(F.translate(packed, "+/=", "-_")).alias("text"),
        F.lit(True).alias("random"),
    )
    total = docs.count()
    share = min(1.0, ordinary_docs / max(total, 1))
    chosen = docs.where(F.pmod(F.xxhash64(text, F.lit(21)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.regexp_extract_all(F.col(text), F.lit("(?<![A-Za-z0-9+/_-])[A-Za-z]{3,}(?![A-Za-z0-9+/_-])"), F.lit(0)).alias("w"))
    # Sixty words from the middle of each; texts that repeat are one sample.
    words = chosen.select(F.slice("w", F.greatest((F.size("w") / 2).cast("int") - 30, F.lit(1)), 60).alias("w")).dropDuplicates(["w"])
    joined = [
        F.concat_ws("", F.transform("w", lambda x: F.initcap(x))),
        F.concat_ws("_", F.transform("w", F.lower)),
        F.concat_ws("-", F.transform("w", F.lower)),
        F.concat_ws("/", F.transform("w", F.lower)),
        F.concat_ws("_", F.transform("w", F.upper)),
        F.concat_ws("", F.transform("w", F.lower)),
    ]
    return random.union(words.select(F.explode(F.array(*joined)).alias("text"), F.lit(False).alias("random")))


def scan_secrets(docs: DataFrame, weights: list[int] | None, *, text: str = "text", carry: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """The columns to carry, and base and spans: arrays of (start, kind, end), kind a number in KINDS, sorted."""
    df = docs.select(F.struct(*carry).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = places(df, ASSIGN, "assign", F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")))
    df = places(df, ACCESS, "access", F.contains("text", F.lit("AKIA")))
    df = places(df, HEX, "hex", F.lit(True))
    value = F.transform("assign_m", lambda m: F.regexp_extract(m, ASSIGN, 2))
    long = F.zip_with(spans_of("assign", "assign"), value, lambda s, v: F.when(F.length(v) >= ASSIGN_LEAST, s))
    df = df.withColumn("assign", F.when(F.size("assign_m") > 0, F.filter(long, lambda s: s.isNotNull())).otherwise(no_spans()))
    df = df.withColumn("base", F.array_sort(F.concat("assign", spans_of("access", "access"), spans_of("hex", "hex"))))
    if weights is None:
        df = df.withColumn("more", no_spans())
    else:
        table = F.lit(weights)
        df = df.withColumn("left", blanked("text", "base"))
        df = places(df, TOKEN, "random", F.lit(True), "left")
        score = lambda token: F.aggregate(pair_codes(token), F.lit(0).cast("long"), lambda acc, code: acc + F.element_at(table, code + 1))
        found = F.zip_with(spans_of("random", "random"), F.col("random_m"), lambda s, token: F.when(score(token) >= threshold, s))
        df = df.withColumn("more", F.when(F.size("random_m") > 0, F.filter(found, lambda s: s.isNotNull())).otherwise(no_spans()))
    return df.select("__row.*", "text", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: str, spans: str, by: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with new content for its spans: by(span, where spans before it end, the text's part up to the span)."""
    ends = F.concat(F.array(F.lit(0).cast("long")), running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)))

    def piece(s: Column, i: Column) -> Column:
        done = F.element_at(ends, i + 1)
        gap = F.when(s["start"] > done, F.col(text).substr((done + 1).cast("int"), (s["start"] - done).cast("int"))).otherwise(F.lit(""))
        return by(s, done, gap)

    rest = F.col(text).substr((F.element_at(ends, -1) + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.concat_ws("", F.transform(spans, piece)), rest)).otherwise(F.col(text))


def blanked(text: str, spans: str) -> Column:
    """The text with BLANK for each character of its spans, so that places stay."""
    return replaced(text, spans, lambda s, done, gap: F.concat(gap, F.repeat(F.lit(BLANK), F.greatest(s["end"] - F.greatest(s["start"], done), F.lit(0)).cast("int"))))


def redacted(text: str, spans: str, mark: str = MARK) -> Column:
    """The text with each run of overlapping spans replaced by the mark."""
    return replaced(text, spans, lambda s, done, gap: F.when(s["start"] >= done, F.concat(gap, F.lit(mark))).otherwise(F.lit("")))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = scan_secrets(docs, train_markov(labelled_samples(docs)), carry=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )
