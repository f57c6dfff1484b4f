"""Surrogates for personal data, by built-in functions only.

Detected entities get keyed replacements of their own kind: digits for digits, letters of the same script and case,
valid IP octets, card numbers that pass the check digit if the original does, names that fit the title's gender and the
script. What an entity becomes depends on the key and its canonical form, so one entity has one surrogate in all
documents, however it is punctuated (coreference).

Surrogates are drawn from a keyed hash. The distinct entities of the table are then checked: none may share a surrogate
with another, and none may become an entity that really occurs. The few that do draw again until they differ
(distinctness). Only these exceptions are carried back to the documents; all others are computed in place.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, fresh, saved

#: The setting that holds the secret key.
KEY = "spark.tonearm.pii.key"
#: Up to so many exceptions travel as a literal map; more are joined.
MAP_ROWS = 5000
#: From this attempt on, surrogates of a fixed format are longer than the format.
WIDE = 4

_SEP = r"(?:[#%&*$!]{2,3})?(?: \|)?[ .-]?"
#: Titles by gender, then the alternatives in the order they are tried.
_MALE, _FEMALE, _ANY = "Mr|Herr|Monsieur|Señor|Господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Госпожа", "Dr|Prof"
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "phone": rf"(?<![\p{{L}}\p{{N}}])(?:\+\d{{1,3}}{_SEP}\(?\d{{2,4}}\)?{_SEP}\d{{3,4}}{_SEP}\d{{3,4}}|\(\d{{3}}\){_SEP}\d{{3}}-\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\p{L}\d])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_MALE}|{_FEMALE}|{_ANY})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
ORDER = ("email", "ip", "phone", "ssn", "secret", "iban", "card", "name")
#: A text without any of these has no entity: every kind holds two adjacent digits, or its own part of these.
CUE = rf"\d{{2}}|@|\d\.\d{{1,3}}\.\d|[0-9a-f]{{32}}|[0-9A-F]{{32}}|AKIA[0-9A-Z]{{16}}|(?<!\p{{L}})(?:{_MALE}|{_FEMALE}|{_ANY})\.? \p{{Lu}}"
ANY = "|".join(KINDS[k] for k in ORDER)

_GIVEN = {("m", "l"): ("Alan", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo"), ("f", "l"): ("Anna", "Berta", "Clara", "Dora", "Emma", "Frida", "Greta", "Helen"), ("m", "c"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"), ("f", "c"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Лидия")}
_SYLLABLES = {"l": ("bar", "den", "fel", "gor", "hal", "kem", "lin", "mor", "nas", "pel", "rad", "sol", "tam", "ver", "wes", "zan"), "c": ("бар", "ден", "фел", "гор", "хал", "кем", "лин", "мор", "нас", "пел", "рад", "сол", "там", "вер", "вес", "зан")}


def session_key(spark: SparkSession) -> str:
    """The key in the setting KEY. Where it is unset one is drawn and kept in the session: surrogates then agree within it only."""
    key = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def entities(text: Column) -> Column:
    """The entities' surface forms, in order."""
    return F.when(text.rlike(CUE), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))


def kind_of(surface: Column) -> Column:
    out = F.lit("name")
    for k in reversed(ORDER[:-1]):
        shape = KINDS[k]
        out = F.when(surface.rlike(rf"^(?:{shape})$"), k).otherwise(out)
    return out


def canonical(kind: Column, surface: Column) -> Column:
    """The same for all ways to write an entity."""
    digits = F.regexp_replace(surface, r"[^0-9]", "")
    return (
        F.when(kind.isin("email", "secret"), F.lower(surface))
        .when(kind.isin("phone", "ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(surface, " ", ""))
        .when(kind == "name", F.regexp_replace(F.regexp_replace(surface, r"\.", ""), " +", " "))
        .otherwise(surface)
    )


def _luhn(digits: Column) -> Column:
    """The check sum of the digits, counted from the last, modulo 10."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: (lambda d, twice: F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))(F.substring(digits, i, F.lit(1)).cast("int"), ((n - i) % 2) == 1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def with_fields(items: Column, names: list[str], **new) -> Column:
    """An array of structs with further fields, each made from the struct. In steps, as each field is then computed once."""
    return F.transform(items, lambda x: F.struct(*(x[n].alias(n) for n in names), *(make(x).alias(n) for n, make in new.items())))


def surrogates(items: Column, names: list[str], key: str) -> Column:
    """Structs with kind, canon and attempt get drawn: the canonical form of the surrogate of that attempt, and more.

    more: by how many characters it is longer than the canonical form. Addresses and names grow with every attempt, what
    has a fixed format from attempt WIDE on, so that the surrogates still free always outnumber the entities in the end.
    """
    at = lambda s, i: F.substring(s, i, F.lit(1))
    word = lambda x: F.concat_ws("|", x["kind"], x["canon"], x["attempt"].cast("string"))
    items = with_fields(items, names, h=lambda x: F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), word(x)), 256)), 256))
    items = with_fields(
        items,
        [*names, "h"],
        long=lambda x: F.repeat(x["h"], F.floor(F.length(x["canon"]) / 64).cast("int") + 1),
        first=lambda x: F.when(x["kind"].isin("phone", "card"), 2).when(x["kind"] == "iban", 3).otherwise(1),
        more=lambda x: F.when(x["kind"] == "email", x["attempt"]).when(x["kind"] == "name", 0).otherwise(F.greatest(x["attempt"] - (WIDE - 1), F.lit(0))),
        last=lambda x: F.length(x["canon"]) - F.when(x["kind"] == "email", F.length(F.substring_index(x["canon"], ".", -1)) + 1).otherwise(0),
    )
    names = [*names, "h", "more", "first", "last"]
    items = with_fields(items, [*names, "long"], **{n: (lambda x, a=a, b=b: F.translate(x["long"], a, b)) for n, a, b in (("digit", "abcdef", "135790"), ("latin", "0123456789abcdef", "aeioubdfgklmnprt"), ("other", "0123456789abcdef", "аеиоубдфгклмнпрт"))})

    def shaped(x: Column) -> Column:
        """The canonical form with the characters from first to last redrawn within their class."""

        def one(i: Column) -> Column:
            c = at(x["canon"], i)
            letter = F.when(c.rlike(r"^\p{IsCyrillic}$"), at(x["other"], i)).otherwise(at(x["latin"], i))
            drawn = F.when(c.rlike(r"^\d$"), at(x["digit"], i)).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)
            return F.when((i < x["first"]) | (i > x["last"]), c).otherwise(drawn)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x["canon"])), one), "")

    items = with_fields(items, [*names, "long", "digit", "latin"], shape=lambda x: F.when(x["kind"].isin("email", "phone", "ssn", "iban", "card"), shaped(x)).otherwise(x["canon"]))
    part = lambda x, i: F.conv(F.substring(x["h"], 1 + 4 * i, 4), 16, 10).cast("int")
    extra = lambda x, chars: F.substring(F.repeat(x[chars], F.floor(x["more"] / 64).cast("int") + 1), F.lit(1), x["more"])
    body = lambda x: F.concat(F.substring(x["shape"], F.lit(1), F.length(x["shape"]) - 1), extra(x, "digit"))

    def name(x: Column) -> Column:
        title = F.regexp_extract(x["canon"], r"^(\S+) ", 1)
        male = F.when(title.rlike(rf"^(?:{_MALE})$"), True).when(title.rlike(rf"^(?:{_FEMALE})$"), False).otherwise(part(x, 9) % 2 == 0)
        pick = lambda names, i: F.get(F.array(*(F.lit(v) for v in names)), part(x, i) % len(names))
        # a syllable more with each attempt
        syllable = lambda s, i: F.get(F.array(*(F.lit(v) for v in _SYLLABLES[s])), F.conv(F.substring(x["h"], 1 + F.pmod(i, F.lit(64)).cast("int"), F.lit(1)), 16, 10).cast("int"))
        tail = lambda s: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), x["attempt"]), lambda i: i > 0), lambda i: syllable(s, i + 40)), "")
        family = lambda s: F.initcap(F.concat(*(pick(_SYLLABLES[s], i) for i in (1, 2, 3, 4)), tail(s)))
        own = lambda s: F.concat_ws(" ", title, F.when(x["canon"].rlike(r"^\S+ \S+ \S"), F.when(male, pick(_GIVEN["m", s], 0)).otherwise(pick(_GIVEN["f", s], 0))), family(s))
        return F.when(x["canon"].rlike(r"\p{IsCyrillic}"), own("c")).otherwise(own("l"))

    def drawn(x: Column) -> Column:
        kind, n = x["kind"], F.length(x["canon"])
        card = F.when(_luhn(x["canon"]) == 0, F.concat(body(x), ((10 - _luhn(F.concat(body(x), F.lit("0")))) % 10).cast("string"))).otherwise(F.concat(x["shape"], extra(x, "digit")))
        secret = F.concat(F.when(x["canon"].startswith("akia"), F.concat(F.lit("akia"), F.substring(x["h"], 1, 16))).otherwise(F.substring(x["long"], F.lit(1), n)), extra(x, "long"))
        ip = F.concat(F.concat_ws(".", *((part(x, i) % 223 + 1).cast("string") for i in range(4))), extra(x, "digit"))
        return (
            F.when(kind == "ip", ip).when(kind == "secret", secret).when(kind == "card", card).when(kind == "name", name(x))
            .when(kind == "email", F.concat(extra(x, "latin"), x["shape"])).otherwise(F.concat(x["shape"], extra(x, "digit")))
        )

    return with_fields(items, [*names, "long", "digit", "latin", "shape"], drawn=drawn)


def dressed(x: Column) -> Column:
    """A surrogate's canonical form with the punctuation and case of the surface form s that it replaces.

    What is longer than s stands before an address and after all else.
    """
    kind, s, new = x["kind"], x["s"], x["drawn"]
    lead = F.when(kind == "email", x["more"]).otherwise(0)

    def one(i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        j = F.length(F.regexp_replace(F.substring(s, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        fit = F.substring(x["plain"], lead + j, F.lit(1))
        return F.when(~c.rlike(r"^[\p{L}\p{N}]$"), c).when(c.rlike(r"^\p{Lu}$"), F.upper(fit)).otherwise(fit)

    filled = F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")
    begin = F.substring(x["plain"], F.lit(1), lead)
    begin = F.when((s == F.upper(s)) & s.rlike(r"\p{Lu}"), F.upper(begin)).otherwise(begin)
    end = F.when(kind == "email", "").otherwise(F.substring(x["plain"], F.length(x["plain"]) - x["more"] + 1, x["more"]))
    direct = F.when((s == F.upper(s)) & s.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
    name = F.when(s.rlike(r"^\S+\. "), F.regexp_replace(new, "^(\\S+) ", "$1. ")).otherwise(new)
    return F.when(kind.isin("ip", "secret"), direct).when(kind == "name", name).otherwise(F.concat(begin, filled, end))


def replaced(found: Column, tries: Column, key: str) -> Column:
    """The surrogates of an array of surface forms; tries: draws of the exceptions, by kind and canonical form."""
    items = F.transform(found, lambda s: F.struct(s.alias("s"), kind_of(s).alias("kind")))
    items = with_fields(items, ["s", "kind"], canon=lambda x: canonical(x["kind"], x["s"]))
    items = with_fields(items, ["s", "kind", "canon"], attempt=lambda x: F.coalesce(F.try_element_at(tries, F.concat_ws("|", x["kind"], x["canon"])), F.lit(0)))
    items = surrogates(items, ["s", "kind", "canon", "attempt"], key)
    items = with_fields(items, ["s", "kind", "more", "drawn"], plain=lambda x: F.regexp_replace(x["drawn"], r"[^\p{L}\p{N}]", ""))
    return F.transform(items, dressed)


def assignments(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt: every distinct entity of the column s, and with which draw its surrogate is its own alone.

    Rounds end: with the attempts surrogates grow (see surrogates()), so the share that is taken falls by 10 or more each.
    """
    surface = found.distinct()
    known = surface.select(kind_of(F.col("s")).alias("kind"), "s").select("kind", canonical(F.col("kind"), F.col("s")).alias("canon"))
    pending = known = saved(known.distinct(), "entities")
    done, attempt = None, 0
    while True:
        one = F.array(F.struct("kind", "canon", F.lit(attempt).alias("attempt")))
        drawn = pending.withColumn("drawn", F.get(surrogates(one, ["kind", "canon", "attempt"], key), F.lit(0))["drawn"])
        first = drawn.groupBy("kind", "drawn").agg(F.min("canon").alias("canon"))
        real = known.select("kind", F.col("canon").alias("drawn"))
        first = first.join(real, ["kind", "drawn"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        won = saved(first.select("kind", "canon", "drawn", F.lit(attempt).alias("attempt")), "surrogates")
        done = won if done is None else done.unionByName(won)
        left = saved(pending.join(won, ["kind", "canon"], "left_anti"), "entities")
        if attempt:
            drop_saved(pending)
        pending, attempt = left, attempt + 1
        if pending.isEmpty():
            return done.select("kind", "canon", "attempt")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with surrogates in the text, and n_entities beside it. The key must be kept secret (see session_key).

    A null text stays null and an empty one empty, both with 0 entities; texts without entities are unchanged. Very long
    texts are searched to their end, in one piece. Repeated rows change alike; an empty table stays empty. If the name
    clashes, n_entities gets underscores before it; other columns of any name stay as they are. Texts are searched once:
    rows with what was found in them are written to the shared folder, and only rows with entities are taken apart again.
    """
    (count,) = fresh(docs, "n_entities")
    found, tries, digest, other = fresh(docs, count, "_entities", "_tries", "_digest", "_other")[1:]
    column = F.col(f"`{text}`")
    out = saved(docs.withColumn(found, entities(column)), "searched")
    odd = assignments(out.select(F.explode(f"`{found}`").alias("s")), key).where("attempt > 0")
    odd = odd.select(F.concat_ws("|", "kind", "canon").alias("k"), "attempt")
    some = odd.limit(MAP_ROWS + 1).collect()
    if len(some) <= MAP_ROWS:
        table = F.map_from_arrays(F.lit([r["k"] for r in some]), F.lit([r["attempt"] for r in some])) if some else F.create_map().cast("map<string,int>")
        out = out.withColumn(tries, table)
    else:
        # by the document's text: rows of one text change alike, whatever their ids
        own = out.where(F.size(found) > 0).select(F.sha2(column, 256).alias("_t"), F.explode(F.array_distinct(found)).alias("s")).distinct()
        own = own.withColumn("kind", kind_of(F.col("s"))).withColumn("k", F.concat_ws("|", "kind", canonical(F.col("kind"), F.col("s"))))
        own = own.join(odd, "k").groupBy("_t").agg(F.collect_set(F.struct("k", "attempt")).alias("x")).select(F.col("_t").alias(other), F.map_from_entries("x").alias(tries))
        out = out.withColumn(digest, F.when(F.size(found) > 0, F.sha2(column, 256)))
        out = out.join(own, F.col(digest) == F.col(other), "left").drop(other, digest)
        out = out.withColumn(tries, F.coalesce(tries, F.create_map().cast("map<string,int>")))

    # what stands between the entities, and the new entities
    gaps = F.split(column, ANY, -1)
    mixed = F.array_join(F.zip_with(gaps, replaced(F.col(found), F.col(tries), key), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.when(F.size(found) > 0, mixed).otherwise(column)
    columns = [changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, F.coalesce(F.size(found), F.lit(0)).cast("long").alias(count))
