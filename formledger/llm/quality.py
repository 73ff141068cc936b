"""Quality rules whose thresholds follow the data; SQL functions only.

Every text is measured once: words, their code points, symbols, lines that repeat an earlier one, words in repeated 3-word
windows, upper-case letters.  Five signals (integers, in thousandths) follow from that.  Fixed cut-offs would call a whole
language or source bad, so each signal's limits come from quantile sketches of that language and source: counts by bucket, with
buckets that are exact for small values and ``1 / 2**BITS`` wide (relative to the value) above.  Sketches merge by adding
counts, so those of a language, and of everything, are sums of the finest ones; a group with fewer than ``LEAST`` documents
takes the limits of the next larger one.  A limit lies ``FENCE`` spreads (quartile to quartile, at least the signal's unit)
beyond the quartile, so what most documents of a group do is never an outlier.  The limits, one row a group, are then
joined with the measures.  Only documents that pass the base rules are sketched, for junk shouldn't widen the limits.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are groups of their
own; rows may repeat (each is judged, each counts in the sketches); whole texts are read, however long; windows are compared by
64-bit hashes of their words; columns of any other name stay out of the way, since only named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

# The base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 3  #: words
LEAST_WORDS = 50
REPEATED_OF_100 = 50

WHITE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
BITS = 5  #: of a value that its bucket keeps
LEAST = 200  #: documents that a group's own limits need
FENCE = 3  #: spreads beyond the quartile
#: Signal: (numerator, denominator, least spread, whether low values are outliers too).
SIGNALS = {
    "word_length": ("word_chars", "n_words", 500, True),
    "symbols": ("n_symbols", "n_words", 20, False),
    "upper": ("n_upper", "word_chars", 40, False),
    "same_lines": ("n_dup_lines", "n_lines", 200, False),
    "repeats": ("n_repeat_words", "n_words", 100, False),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(inner) > 0, F.split(inner, GAP)).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a window of ``WINDOW`` words whose words occur twice or more.

    Windows are sorted by hash, neighbours with equal hashes are repeats; the places of these, in order, tell how many words they cover.
    """
    at = lambda w, i, k: F.get(w, i + k)
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[at(w, i, k) for k in range(WINDOW)]))

    def places(h: Column) -> Column:
        twice = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.sort_array(F.transform(_let(marked, twice), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        own = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(places(h), covered)).otherwise(0)
    return F.when(F.size(words) >= WINDOW, _let(hashes(words), some)).otherwise(0)


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the measures of each row's text."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda letters: F.length(t) - F.length(F.translate(t, letters, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    counts = lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    same = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    found = {
        "by_word": _let(words(t), counts),
        "by_line": _let(lines, same),
        "word_chars": F.length(t) - without(WHITE),
        "n_symbols": without(SYMBOLS),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
    }
    own = F.struct(*[c.alias(n) for n, c in found.items()])
    name = common.fresh(docs, "measures")[0]
    rows = docs.select(*keep, own.alias(name))
    inner = {"n_words": "by_word.n_words", "n_repeat_words": "by_word.n_repeat_words", "n_lines": "by_line.n_lines", "n_dup_lines": "by_line.n_dup_lines"}
    return rows.select(*keep, *[F.col(f"{name}.{inner.get(m, m)}").cast("long").alias(m) for m in MEASURES])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_OF_100 * F.col("n_words"))


def signal(name: str) -> Column:
    """A signal in thousandths; 0 where it has no denominator."""
    top, of, _, _ = SIGNALS[name]
    return F.when(F.col(of) > 0, F.floor(1000 * F.col(top) / F.col(of))).otherwise(0).cast("long")


def bucket(value: Column) -> Column:
    """Number of a value's bucket: the value itself below 2 ** (BITS + 1), then its leading bits."""
    e = F.greatest(F.lit(0), F.length(F.bin(value)) - (BITS + 1))
    return F.when(value < 2 << BITS, value).otherwise(e * (1 << BITS) + F.call_function("shiftright", value, e)).cast("long")


def bucket_end(number: Column) -> Column:
    """The largest value of a bucket."""
    e = F.floor(number / (1 << BITS)).cast("int") - 1
    top = F.call_function("shiftleft", (number - e * (1 << BITS) + 1).cast("long"), e) - 1
    return F.when(number < 2 << BITS, number).otherwise(top).cast("long")


def sketches(measures: DataFrame, *groups: str) -> DataFrame:
    """*groups, signal, bucket, n of what passes the base rules: one sketch for each group and signal."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), bucket(signal(s)).alias("bucket")) for s in SIGNALS])).alias("x")
    return measures.where(~base_failed()).select(*groups, each).groupBy(*groups, "x.signal", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *groups: str) -> DataFrame:
    """Sketches of larger groups: counts of equal buckets are added."""
    return sketch.groupBy(*groups, "signal", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, *groups: str) -> DataFrame:
    """*groups, total, limits (signal to low and high): the quartiles of each sketch and what lies ``FENCE`` spreads beyond."""
    by = Window.partitionBy(*groups, "signal")
    upto = F.sum("n").over(by.orderBy("bucket"))
    placed = sketch.withColumn("total", F.sum("n").over(by)).withColumn("upto", upto)
    quartile = lambda k: bucket_end(F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket"))))
    q = placed.groupBy(*groups, "signal").agg(F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    unit, two = F.lit(0), F.lit(False)
    for s, (_, _, least, sides) in SIGNALS.items():
        unit, two = F.when(F.col("signal") == s, least).otherwise(unit), F.when(F.col("signal") == s, sides).otherwise(two)
    spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), unit)
    own = q.select(*groups, "total", "signal", F.when(two, F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    pick = lambda s, side: F.max(F.when(F.col("signal") == s, F.col(side))).alias(f"{s}_{side}")
    return own.groupBy(*groups).agg(F.max("total").alias("total"), *[pick(s, side) for s in SIGNALS for side in ("low", "high")])


def thresholds(sketch: DataFrame, lang: str, source: str) -> DataFrame:
    """lang, source and the limits that hold there: its own, its language's or those of everything, the first with enough documents."""
    names = [f"{s}_{side}" for s in SIGNALS for side in ("low", "high")]
    own, by_lang, all_ = limits(sketch, lang, source), limits(merged(sketch, lang), lang), limits(merged(sketch))
    by_lang = by_lang.select(F.col(lang).alias("_lang"), F.col("total").alias("_total"), *[F.col(n).alias(f"_{n}") for n in names])
    # one row, of ten numbers
    rows = own.join(by_lang, F.col(lang).eqNullSafe(F.col("_lang")), "left").crossJoin(F.broadcast(all_.select(*[F.col(n).alias(f"__{n}") for n in names])))
    best = lambda n: F.when(F.col("total") >= LEAST, F.col(n)).when(F.col("_total") >= LEAST, F.col(f"_{n}")).otherwise(F.col(f"__{n}"))
    return rows.select(lang, source, *[best(n).alias(n) for n in names])


def within() -> Column:
    out = F.lit(True)
    for s in SIGNALS:
        out = out & (signal(s) <= F.col(f"{s}_high")) & F.coalesce(signal(s) >= F.col(f"{s}_low"), F.lit(True))
    return out


def judged(docs: DataFrame, id_col: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """id, lang, source, measures, base_failed and kept of each row."""
    named = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = common.settled(measured(named, ["id", "lang", "source"]), "quality-measures")
    sketch = common.settled(sketches(rows, "lang", "source"), "quality-sketches")
    limit = common.narrow(common.settled(thresholds(sketch, "lang", "source"), "quality-limits").withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    met = rows.join(limit, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return met.select("id", "lang", "source", *MEASURES, base_failed().alias("base_failed"), (~base_failed() & F.coalesce(within(), F.lit(False))).alias("kept"))


def oracle() -> str:
    """DuckDB SQL of ``judged`` over ``documents``, in the columns of the query."""
    word = r"'[^\x20\x09-\x0D]+'"
    signals = {s: f"case when {of} > 0 then 1000 * {top} // {of} else 0 end" for s, (top, of, _, _) in SIGNALS.items()}
    sketch = " union all ".join(f"select lang, source, '{s}' as signal, {x} as v from ok" for s, x in signals.items())
    unit = "case signal " + " ".join(f"when '{s}' then {u}" for s, (_, _, u, _) in SIGNALS.items()) + " end"
    two = ", ".join(f"'{s}'" for s, x in SIGNALS.items() if x[3])
    fits = " and ".join(
        f"{signals[s]} <= t.{s}_high" + (f" and {signals[s]} >= t.{s}_low" if SIGNALS[s][3] else "") for s in SIGNALS
    )
    names = [f"{s}_{side}" for s in SIGNALS for side in ("low", "high")]

    def level(name: str, source: str, *groups: str) -> str:
        keys = "".join(f"{g}, " for g in groups)
        part = f"partition by {keys}signal"
        sums = f"select {keys}signal, bucket, sum(n) as n from {source} group by {keys}signal, bucket"
        run = f"select *, sum(n) over ({part}) as total, sum(n) over ({part} order by bucket) as upto from ({sums})"
        low, high = ("min(case when 4 * upto >= %d * total then bucket end)" % k for k in (1, 3))
        end = "case when {0} < %d then {0} else (({0} - ({0} // %d - 1) * %d + 1) << ({0} // %d - 1)::int) - 1 end" % (2 << BITS, *[1 << BITS] * 3)
        q = f"select {keys}signal, max(total) as total, ({low})::bigint as b1, ({high})::bigint as b3 from ({run}) group by {keys}signal"
        ends = f"select {keys}signal, total, {end.format('b1')} as q1, {end.format('b3')} as q3 from ({q})"
        fence = f"select {keys}signal, total, case when signal in ({two}) then q1 - {FENCE} * greatest(q3 - q1, {unit}) end as low, q3 + {FENCE} * greatest(q3 - q1, {unit}) as high from ({ends})"
        picks = ", ".join(f"max(case when signal = '{s}' then {side} end) as {s}_{side}" for s in SIGNALS for side in ("low", "high"))
        return f"{name} as (select {keys}max(total) as total, {picks} from ({fence}) {'group by ' + keys.rstrip(', ') if groups else ''})"

    chosen = ", ".join(f"case when o.total >= {LEAST} then o.{n} when l.total >= {LEAST} then l.{n} else a.{n} end as {n}" for n in names)
    return f"""
    with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
    w as (select r, regexp_extract_all(text, {word}) as ws from d),
    g as (select r, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
    again as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from g) where n > 1),
    hit as (select r, count(distinct i + k) as n_repeat_words from again, (values (0), (1), (2)) as s(k) group by r),
    ln as (select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, {word}) group by r),
    m as (
      select d.r, doc_id, lang, source, len(ws)::bigint as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(regexp_extract_all(text, '\\p{{Lu}}'))::bigint as n_upper, coalesce(n_lines, 0)::bigint as n_lines
      from d join w using (r) left join hit using (r) left join ln using (r)),
    f as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_OF_100} * n_words as base_failed from m),
    ok as (select * from f where not base_failed),
    v as ({sketch}),
    k as (select lang, source, signal, case when v < {2 << BITS} then v else {1 << BITS} * (length(bin(v)) - {BITS + 1}) + (v >> (length(bin(v)) - {BITS + 1})::int) end as bucket, count(*) as n from v group by all),
    {level('o', 'k', 'lang', 'source')},
    {level('l', 'k', 'lang')},
    {level('a', 'k')},
    t as (select o.lang, o.source, {chosen} from o left join l on o.lang is not distinct from l.lang cross join a)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({fits}, false) as kept
    from f left join t on f.lang is not distinct from t.lang and f.source is not distinct from t.source
    """
