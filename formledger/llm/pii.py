"""PII: detected entities get keyed surrogates of the same kind; SQL functions only.

Kinds: e-mail addresses, phone numbers, payment cards (with a valid check digit), IPv4 addresses, social security numbers,
IBANs, and names after a title.  A surrogate keeps what the entity looks like:

* digits become other digits, everything between them stays; of phone numbers the country code
  stays, octets of addresses keep their lengths; cards keep their length and get a valid check digit, IBANs keep their country
  and have valid check digits if they had them;
* the letters of an e-mail's local part become other letters of the same case and script, its digits other digits; the
  domain becomes one of the reserved example domains of equal depth;
* names come from lists by gender (that of the title) and script (that of the name), in the case of the name.

A surrogate is a function of key, kind, entity and an attempt number; the entity is normalised, so all its mentions get
the same one (coreference), whatever separates the digits; a title's gender belongs to the name.  Collision check: the distinct entities of all documents are counted by surrogate; of those that
share one (or meet an entity that is itself in the documents) all but the first try the next attempt, until none collide.
Each attempt after the first has a larger space: names get one more last name, local parts one more letter, octets any
length.  Numbers keep their digits; if there are more of a form than it has values, ``LIMIT`` ends it with an error.
The few attempts above 0 go back to the documents in a join, by broadcast only below a counted bound.

Every part of a pattern that may repeat has a bound (the local part of an address 64 characters, its domain 33 labels, as names of hosts
have them), so the time for a text follows its length.  Of what is longer the end is taken.

Defined results: null texts stay null, empty ones empty; rows may repeat and are treated alike; overlapping detections go to
the earlier one, then to the order of the kinds; texts are read and rewritten whole; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KEY = "formledger"  #: replace it by a secret of your own
LIMIT = 64  #: attempts before a form counts as full, which is an error

# The patterns, in order of precedence.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,32}[A-Za-z]{2,63}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "name": r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora|Г-н|Г-жа)\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these has no entity.
SIGNS = r"@|[0-9]{3}|[0-9]\.[0-9]|\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora|Г-н|Г-жа)\b"
#: Country codes, by the first digits: how a mention separates them says nothing.
COUNTRY = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Señora|Г-жа)\b"
# Names by gender and script.
FIRST = {
    ("f", "latin"): "Anna Maria Laura Emma Julia Clara Elena Sofia Nora Alice Irene Marta Paula Lucia Helen Rosa Ada Edith Grace Vera".split(),
    ("m", "latin"): "Paul Martin Thomas Peter Simon David Robert Victor Hugo Felix Oscar Leon Arthur Daniel Albert Anton Emil Ivan Karl Louis".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Вера Нина Софья Дарья Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Павел Антон Сергей Виктор Николай Андрей Денис Роман".split(),
}
LAST = {
    "latin": "Arden Bellamy Corwin Dalton Ellery Farrow Garland Hollis Ingram Jarvis Kendall Lorimer Merrick Norwood Ormond Preston Quillan Radley Selwyn Thorne".split(),
    "cyrillic": "Белов Громов Дёмин Ершов Зотов Котов Лосев Мохов Носов Орлов".split(),
}
DOMAINS = "example.com example.org example.net".split()


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole entity."""
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _weighed(number: Column) -> Column:
    """Luhn's sum of the digits in a string."""
    digits = F.filter(F.reverse(F.split(_digits(number), "")), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))


def _mod97(number: Column) -> Column:
    """Remainder of a string of digits and capitals (A is 10, B 11, ...), as IBANs have it."""

    def step(a: Column, c: Column) -> Column:
        return F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(number, ""), F.lit(0), step)


def _iban(x: Column) -> Column:
    country, account = F.substring(x["plain"], 1, 2), F.substring(x["body"], F.lit(5), F.length(x["plain"]))
    valid = _mod97(F.concat(F.substring(x["plain"], F.lit(5), F.length(x["plain"])), F.substring(x["plain"], 1, 4))) == 1
    digits = F.when(valid, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substring(x["body"], 3, 2))
    return F.concat(country, digits, account)


def normal(kind: Column, entity: Column) -> Column:
    """The form in which mentions of one entity are equal."""
    name = F.concat(F.when(entity.rlike(FEMALE), "f ").otherwise("m "), F.regexp_replace(F.regexp_replace(F.lower(entity), r"^\S+ ", ""), r"\s+", " "))
    return F.when(kind == "email", F.lower(entity)).when(kind == "name", name).when(kind == "ip", entity).otherwise(F.regexp_replace(F.upper(entity), "[^0-9A-Z+]", ""))


def _stream(key: str, *parts: Column) -> Column:
    """64 keyed hex digits, and 64 more."""
    text = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(text, 256), F.sha2(F.concat(text, F.lit("\x1f+")), 256))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th number of the stream (0 to 65535); it begins anew after 61."""
    return F.conv(F.substring(stream, F.pmod(i * 2, F.lit(122)) + 1, F.lit(4)), 16, 10).cast("int")


def _rewritten(s: Column, stream: Column) -> Column:
    """Letters become letters of the same case and script, digits digits; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        pick = lambda letters: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike("[а-яё]"), pick("абвгдежзийклмнопрстуфхцчшщыэюя"))
            .when(c.rlike("[А-ЯЁ]"), pick("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(s, ""), one), "")


def _listed(words: list[str], stream: Column, at: int | Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), F.pmod(_byte(stream, at if isinstance(at, Column) else F.lit(at)), F.lit(len(words))).cast("int") + 1)


def _tail(s: Column) -> Column:
    return F.substring(s, F.lit(2), F.length(s))


def _octet(p: Column, n: Column) -> Column:
    """An octet of as many digits."""
    return F.when(F.length(p) == 1, n % 10).when(F.length(p) == 2, n % 90 + 10).otherwise(n % 156 + 100).cast("string")


def _with(items: Column, **fields) -> Column:
    """Add fields to an array of structs, each from a function of the struct.

    Each call is a step of its own, so what a step computes is a field for the next and isn't computed again.
    """

    def wider(x: Column) -> Column:
        out = x
        for name, f in fields.items():
            out = out.withField(name, f(x))
        return out

    return F.transform(items, wider)


def described(found: Column) -> Column:
    """Structs of e, kind, norm and ok (a card needs a valid check digit) for an array of entities."""
    items = F.transform(found, lambda x: F.struct(x.alias("e"), kind_of(x).alias("kind")))
    return _with(items, norm=lambda x: normal(x["kind"], x["e"]), ok=lambda x: (x["kind"] != "card") | (_weighed(x["e"]) % 10 == 0))


def named(x: Column) -> Column:
    return F.concat_ws("\x1f", x["kind"], x["norm"])


def _email(x: Column) -> Column:
    domain = F.substring_index(x["e"], "@", -1)
    below = _rewritten(F.regexp_extract(domain, r"^(.*?)(?:[^.]+\.[^.]+)$", 1), x["rest"])
    # one more letter for each further attempt: local parts can be short
    more = F.array_join(F.transform(F.sequence(F.lit(0), x["attempt"]), lambda k: F.when(k > 0, F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(x["rest"], k * 5) % 26 + 1, F.lit(1))).otherwise("")), "")
    return F.concat(F.substring_index(x["body"], "@", 1), more, F.lit("@"), below, _listed(DOMAINS, x["stream"], 40))


def _laid(letters: Column, mention: Column) -> Column:
    """The letters and digits in turn, with what stands between those of the mention."""
    before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^0-9A-Za-z]", ""))
    return F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(letters, before(i) + 1, F.lit(1))).otherwise(c)), "")


def _phone(x: Column) -> Column:
    country = F.greatest(F.lit(0), F.length(F.regexp_extract(x["norm"], COUNTRY, 0)) - 1)
    return F.concat(F.substring(x["plain"], F.lit(1), country), F.substring(x["body"], country + 1, F.length(x["plain"])))


def _person(x: Column) -> Column:
    title, name, stream = F.regexp_extract(x["e"], r"^(\S+) ", 1), F.regexp_replace(x["e"], r"^\S+ ", ""), x["stream"]
    cyrillic, female = name.rlike(r"\p{IsCyrillic}"), x["e"].rlike(FEMALE)
    first = F.when(cyrillic, F.when(female, _listed(FIRST["f", "cyrillic"], stream, 3)).otherwise(_listed(FIRST["m", "cyrillic"], stream, 3))).otherwise(F.when(female, _listed(FIRST["f", "latin"], stream, 3)).otherwise(_listed(FIRST["m", "latin"], stream, 3)))
    last = lambda at: F.when(cyrillic, _listed(LAST["cyrillic"], stream, at)).otherwise(_listed(LAST["latin"], stream, at))
    # each further attempt has one more last name: the lists alone are short
    lasts = F.array_join(F.transform(F.sequence(F.lit(0), x["attempt"]), lambda k: last(k * 4 + 7)), "-")
    full = F.concat(F.when(name.contains(" "), F.concat(first, F.lit(" "))).otherwise(""), lasts)
    return F.concat(title, F.lit(" "), F.when(name == F.upper(name), F.upper(full)).otherwise(full))


def surrogates(items: Column, key: str = KEY) -> Column:
    """Add ``s``, what replaces the entity, to structs of e, kind, norm, ok and attempt: of its kind, length and form."""
    items = _with(items, stream=lambda x: _stream(key, x["kind"], x["norm"], x["attempt"].cast("string")))
    # numbers are rewritten without what separates their digits, so all forms of one get the same
    items = _with(items, rest=lambda x: F.reverse(x["stream"]), plain=lambda x: F.when(x["kind"] == "email", x["e"]).otherwise(F.regexp_replace(x["norm"], "[^0-9A-Z]", "")))
    items = _with(items, body=lambda x: _rewritten(x["plain"], x["stream"]))
    # the last digit of a card makes its check valid
    items = _with(items, card=lambda x: F.concat(F.substring(x["plain"], 1, 1), F.substring(x["body"], F.lit(2), F.length(x["plain"]) - 2)))
    made = {
        "email": _email,
        "ip": lambda x: F.array_join(F.transform(F.split(x["e"], r"\."), lambda p, i: F.when(x["attempt"] > 1, (_byte(x["stream"], i) % 256).cast("string")).otherwise(_octet(p, _byte(x["stream"], i)))), "."),
    }
    numbers = {
        "phone": _phone,
        "card": lambda x: F.concat(x["card"], F.pmod(-_weighed(F.concat(x["card"], F.lit("0"))), F.lit(10)).cast("string")),
        "iban": _iban,
        "ssn": lambda x: F.concat(F.lit("9"), _tail(x["body"])),  # numbers that begin with 9 are never given out
    }

    def number(x: Column) -> Column:
        out = x["plain"]
        for kind, f in numbers.items():
            out = F.when(x["kind"] == kind, f(x)).otherwise(out)
        return out

    items = _with(items, number=number)

    def one(x: Column) -> Column:
        out = _person(x)
        for kind, f in made.items():
            out = F.when(x["kind"] == kind, f(x)).otherwise(out)
        return F.when(x["kind"].isin(*numbers), _laid(x["number"], x["e"])).otherwise(out)

    return _with(items, s=one)


def entities(text: Column) -> Column:
    """Array of the matches, in order."""
    none = F.array().cast("array<string>")
    return F.when(F.regexp_like(text, F.lit(SIGNS)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def settle_attempts(found: DataFrame, key: str = KEY) -> DataFrame:
    """kind, norm, attempt for the entities whose surrogate had to be tried again; ``found`` has arrays from ``described``."""
    known = found.select(F.explode("items").alias("x")).where("x.ok").groupBy("x.kind", "x.norm").agg(F.min("x.e").alias("e"))
    n = found.agg(F.sum(F.size("items"))).first()[0] or 0
    state = common.settled(known.withColumn("attempt", F.lit(0)), "entities", rows=n)
    n = state.count()
    own = state.select(F.col("kind").alias("k"), F.col("norm").alias("taken"))
    for _ in range(LIMIT):
        made = surrogates(F.array(F.struct("e", "kind", "norm", F.lit(True).alias("ok"), "attempt")), key)[0]["s"]
        tried = common.settled(state.withColumn("s", normal(F.col("kind"), made)), "tried", rows=n)
        # a surrogate belongs to the entity that needed the most attempts for it, then to the last by its text
        counts = tried.groupBy("kind", "s").agg(F.count("*").alias("c"), F.max_by("norm", F.struct("attempt", "norm")).alias("owner"))
        clash = tried.join(counts.where("c > 1"), ["kind", "s"]).where(F.col("norm") != F.col("owner")).select("kind", "norm")
        meets = tried.join(own, (F.col("k") == F.col("kind")) & (F.col("taken") == F.col("s")), "left_semi").select("kind", "norm")
        again = common.settled(clash.union(meets).distinct().withColumn("more", F.lit(1)), "again", rows=n)
        if not again.take(1):
            return common.settled(state.where("attempt > 0").select("kind", "norm", "attempt"), "attempts", rows=n)
        state = common.settled(state.join(again, ["kind", "norm"], "left").select("kind", "norm", "e", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "entities", rows=n)
    raise ValueError(f"surrogates still collide after {LIMIT} attempts: a form has more entities than values")


def pseudonymised(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``.

    Texts are read three times (detection twice) and never shuffled, unless more than a bound of rows need further attempts.
    """
    t = F.col(f"`{text}`")
    texts = docs.select(F.xxhash64(t).alias("row"), described(entities(t)).alias("items")).where(F.size("items") > 0)
    found = common.settled(texts, "pii-found")
    attempts = settle_attempts(found, key)
    count, own, row, tried = common.fresh(docs, "n_entities", "own_items", "own_row", "own_tried")
    rows, attempt = docs, lambda x: F.lit(0)
    if attempts.take(1):
        # the texts that mention such an entity get a map of their attempts
        keyed = common.narrow(attempts.select(F.concat_ws("\x1f", "kind", "norm").alias("name"), "attempt"))
        names = found.select("row", F.explode("items").alias("x")).select("row", named(F.col("x")).alias("name")).distinct()
        few = names.join(keyed, "name").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias(tried))
        few = common.narrow(common.settled(few.withColumnRenamed("row", row), "pii-tried"))
        rows = docs.withColumn(row, F.xxhash64(t)).join(few, row, "left").drop(row)
        attempt = lambda x: F.coalesce(F.try_element_at(F.col(tried), named(x)), F.lit(0))
    items = surrogates(_with(described(entities(t)), attempt=attempt), key)
    rows = rows.withColumn(own, F.coalesce(F.transform(items, lambda x: F.struct(x["ok"].alias("ok"), F.when(x["ok"], x["s"]).otherwise(x["e"]).alias("s"))), F.array().cast("array<struct<ok:boolean,s:string>>")))
    pieces = F.zip_with(F.split(t, ANY, -1), own, lambda a, x: F.concat(a, F.coalesce(x["s"], F.lit(""))))
    out = rows.withColumn(count, F.size(F.filter(own, lambda x: x["ok"])).cast("long")).withColumn(text, F.when(F.size(own) > 0, F.array_join(pieces, "")).otherwise(t))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], count)
