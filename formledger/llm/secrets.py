"""Secret scans: patterns, and a battery of randomness tests on encoded strings; SQL functions only.

Base spans: matches of three patterns, leftmost and without overlap for each kind.  Further spans come from strings of an
encoding's letters (those of base64 or of base64url, at least ``LEAST`` of them, so a name and ``=`` before a value aren't part
of it; runs of any length are one string, whose neighbours are compared in pieces of ``PIECE`` letters).  For each of these the narrowest alphabet that holds it is its
encoding (digits, hex, base32, letters and digits, base64).  Three statistics are taken in that alphabet: chi-squared
uniformity of the letters, the number of runs above and below the alphabet's middle, and the serial correlation of
neighbours.  A secret looks random, so the hypothesis to be refuted is structure: each statistic is compared with what words
and numbers of this length would give (``CONCENTRATION``, ``CHANGES``, ``SERIAL``), the three normal scores are joined with fixed
weights, and the p-value is the chance that structure looks as random as this.  Longer strings can refute more.
Benjamini-Hochberg control over all strings of all documents follows, in strata of length, so that many short strings do
not drown a long one: each stratum has its own share of false findings.  Ranks come from counts of p-values in bins, so no
task sees all strings.

Defined results: null and empty texts have no spans; rows may repeat (each counts in the control once per row); offsets are
code points, the end exclusive; whole texts are read, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

# The base patterns.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))  #: kind, pattern, least length of what counts
LEAST = 20
PIECE = 4096
#: A candidate has the letters of base64 or those of its form for addresses; first those that take a whole run of letters.
ENCODED = r"(?:[A-Za-z0-9+/]{20,}+(?![A-Za-z0-9+/_-])|[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9+/_-])|[A-Za-z0-9+/]{20,}+|[A-Za-z0-9_-]{20,}+)={0,2}"
CHUNK = 256  #: matches of a text whose places are summed at once
LEVEL = 0.01  #: share of false findings in each stratum
BINS = 400  #: of p-values, on a log scale
STEP = 0.1  #: natural logs in a bin
#: Structure: the chance that two letters of a word are equal, the share of neighbours on different sides of the alphabet's
#: middle, and the correlation of neighbours.
CONCENTRATION, CHANGES, SERIAL = 0.066, 0.2, 0.35
WEIGHTS = (0.8, 0.4, 0.4)
#: Encodings, the narrowest first: name, pattern, letters in the order of their values.
ENCODINGS = (
    ("digits", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) in code points: the texts between the matches tell where the matches lie.

    Places are summed in chunks of matches and then over the chunks: an array that grows by each match would be copied as often.
    """
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(got)), lambda s: F.length(s)).alias("gap"), got.alias("match"))
    span = "struct<start:long,end:long,match:string>"
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

    def chunked(all_):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda i: F.aggregate(F.slice(all_, i * CHUNK + 1, F.lit(CHUNK)), none, step))

    def moved(chunks):
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        begins = F.aggregate(chunks, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        shift = lambda x, b: F.transform(x["out"], lambda s: F.struct((s["start"] + b).alias("start"), (s["end"] + b).alias("end"), s["match"].alias("match")))
        return F.flatten(F.zip_with(chunks, begins, shift))

    whole = lambda all_: F.when(F.size(all_) > 0, _let(chunked(all_), moved)).otherwise(F.array().cast(f"array<{span}>"))
    return _let(pairs, whole)


def spans(kind: str, text: Column, pattern: str, least: int) -> Column:
    """Spans of one base kind, those of enough characters."""
    if kind == "assign":
        value = lambda x: F.length(F.regexp_extract(x["match"], pattern, 2)) >= least
    else:
        value = lambda x: F.length(x["match"]) >= least
    return F.filter(found(text, pattern), value)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def battery(strings: DataFrame, string: str = "match") -> DataFrame:
    """Add encoding, z_uniform, z_runs, z_serial and p to strings."""
    s = F.col(string)
    name, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, pattern, alphabet in reversed(ENCODINGS):
        name = F.when(s.rlike(pattern), n).otherwise(name)
        letters = F.when(s.rlike(pattern), alphabet).otherwise(letters)
    out = strings.withColumn("encoding", name).withColumn("letters", letters).where(F.col("encoding").isNotNull())
    out = out.withColumn("body", F.rtrim(s, F.lit("="))).withColumn("m", F.length("letters").cast("double"))
    out = out.withColumn("n", F.length("body").cast("double"))
    without = lambda i: F.replace(F.col("body"), F.substring(F.col("letters"), i, F.lit(1)), F.lit(""))
    counts = F.transform(F.sequence(F.lit(1), F.col("m").cast("int")), lambda i: (F.length("body") - F.length(without(i))).cast("double"))
    expected = F.col("n") / F.col("m")
    chi = _sum(F.transform(counts, lambda c: (c - expected) * (c - expected) / expected))
    out = out.withColumn("chi", chi).withColumn("df", F.col("m") - 1)
    # the variance of the statistic for few letters a cell: 2 (m - 1) (1 - 1 / n)
    out = out.withColumn("z_uniform", (F.col("chi") - F.col("df")) / F.sqrt(2 * F.col("df") * (1 - 1 / F.col("n"))))
    # neighbours: letters are ASCII, so pieces are cut by bytes; each has the next one's first letter too
    piece = lambda i: F.substring(F.col("body").cast("binary"), i * PIECE + 1, F.lit(PIECE + 1)).cast("string")
    values = lambda i: F.transform(F.split(piece(i), ""), lambda c: F.instr(F.col("letters"), c).cast("double") - 1)
    ahead = lambda v: F.slice(v, F.lit(2), F.size(v))
    behind = lambda v: F.slice(v, F.lit(1), F.size(v) - 1)
    scaled = lambda v: F.transform(v, lambda x: (x - (F.col("m") - 1) / 2) / F.sqrt((F.col("m") * F.col("m") - 1) / 12))  # noqa: E731  mean 0 and variance 1 for random strings
    high = lambda v: F.transform(v, lambda x: (x >= F.col("m") / 2).cast("double"))
    pairs = lambda v, f: _sum(F.zip_with(behind(v), ahead(v), f))
    moves = lambda v: F.struct(pairs(high(v), lambda a, b: F.abs(a - b)).alias("changes"), pairs(scaled(v), lambda a, b: a * b).alias("serial"))
    letters = lambda v: F.filter(v, lambda x: x >= 0)  # noqa: E731  splitting leaves an empty end
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / PIECE).cast("int")), lambda i: _let(letters(values(i)), moves))
    out = out.withColumn("pieces", pieces)
    changes, serial = _sum(F.col("pieces.changes")), _sum(F.col("pieces.serial"))
    out = out.withColumn("z_runs", (changes - (F.col("n") - 1) / 2) / F.sqrt((F.col("n") - 1) / 4))
    out = out.withColumn("z_serial", serial / F.sqrt(F.col("n") - 1))
    # what structure gives: a share of repeats that exceeds the uniform one, fewer changes, neighbours alike
    excess = F.greatest(F.lit(0.7), F.col("m") * CONCENTRATION - 1) * (F.col("n") - 1)
    uniform = (F.col("chi") - F.col("df") - excess) / F.sqrt(2 * (F.col("df") + 2 * excess))
    runs = ((F.col("n") - 1) * CHANGES - changes) / (0.4 * F.sqrt(F.col("n") - 1))
    alike = F.col("z_serial") - SERIAL * F.sqrt(F.col("n"))
    score = sum((w * z for w, z in zip(WEIGHTS, (uniform, runs, alike))), F.lit(0.0)) / sum(w * w for w in WEIGHTS) ** 0.5
    return out.withColumn("p", _below(score)).drop("letters", "body", "m", "n", "chi", "df", "pieces")


def _below(z: Column) -> Column:
    """The normal distribution's share below z, by a closed form with a relative error of about a hundredth in both tails."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / (1.64 * x + F.sqrt(0.76 * x * x + 4))
    return F.when(z < 0, tail).otherwise(1 - tail)



def controlled(tested: DataFrame, level: float = LEVEL) -> DataFrame:
    """The strings that pass Benjamini-Hochberg control in their stratum of length; p-values count as the upper end of their bin."""
    stratum = F.floor(F.log2(F.length("match").cast("double")))
    binned = tested.withColumn("stratum", stratum).withColumn("bin", F.least(F.lit(BINS), F.floor(-F.log("p") / STEP)).cast("int"))
    counts = binned.groupBy("stratum", "bin").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy("stratum"))
    below = F.sum("c").over(Window.partitionBy("stratum").orderBy(F.desc("bin")))  # p-values not above this bin's
    cut = counts.withColumn("ok", F.exp(-F.col("bin") * STEP) * total <= level * below).where("ok").groupBy("stratum").agg(F.min("bin").alias("cut"))
    return binned.join(F.broadcast(cut), "stratum").where("bin >= cut").drop("stratum", "bin", "cut")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", level: float = LEVEL) -> DataFrame:
    """id, assign, access, hex: arrays of base spans; random: array of further spans; for each row.

    The key of a row is its id and text digest, so rows that repeat share what is found.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    quick = {"assign": F.regexp_like(t, F.lit(ASSIGN)), "access": F.contains(t, F.lit("AKIA")), "hex": F.regexp_like(t, F.lit(HEX))}
    none = F.array().cast("array<struct<start:long,end:long,match:string>>")
    columns = [F.when(quick[k], spans(k, t, pattern, least)).otherwise(none).alias(k) for k, pattern, least in KINDS]
    strings = F.when(F.regexp_like(t, F.lit(ENCODED)), found(t, ENCODED)).otherwise(none).alias("strings")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("key"), *columns, strings)
    rows = common.settled(rows, "secret-rows")
    each = rows.select("id", "key", F.explode("strings").alias("s")).select("id", "key", "s.*")
    passed = controlled(battery(each), level)
    more = passed.groupBy(F.col("id").alias("own_id"), F.col("key").alias("own_key")).agg(F.array_sort(F.collect_set(F.struct("start", "end", "encoding"))).alias("random"))
    out = rows.drop("strings").join(more, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")), "left")
    return out.select("id", "assign", "access", "hex", F.coalesce("random", F.array().cast("array<struct<start:long,end:long,encoding:string>>")).alias("random"))


def _named(kind: str, rank: int, items: Column) -> Column:
    return F.transform(items, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")).alias("name")))


def listed(*kinds: str) -> Column:
    """kind:start:end of the named columns, by start, then in the order of the names, joined by commas."""
    items = F.array_sort(F.concat(*[_named(k, i, F.col(k)) for i, k in enumerate(kinds)]))
    return F.array_join(F.transform(items, lambda x: x["name"]), ",")
