"""Surrogates for personal data, with DataFrame and SQL functions alone.

Detected entities (e-mail addresses, IPv4 addresses, card, phone and social security numbers,
account numbers, titled names) are replaced by keyed surrogates of the same type, script and format:

* Each character becomes another one of its own class (digit, vowel or consonant, with or without accent, of
  its script), shifted by a keyed SHA-256 of the characters before it; a second pass runs backward.
  Both are reversible for whoever has the key, so different entities of one format
  stay different; case and separators are copied.
* Octets of addresses are shifted alike, modulo 256. A card number keeps its check-sum residue,
  a phone number its first digit after the plus, a mail address its top-level domain.
* A name keeps its title and each part's last letter, which carry the gender; parts move on their own, so that a
  surname alone and with a first name stay the same. Names are found after a title; later and earlier mentions of
  such a name's parts without one, in the same text, are replaced alike.

Equal entities, also in other case or with other separators, get equal surrogates (coreference).
Collision checks over all distinct entities find surrogates that equal an entity of the corpus, or
another one's surrogate, or their own entity; these are drawn again with a tweak. What collides in all of ROUNDS
draws, since its format has hardly a free surrogate, becomes a placeholder of its kind and a keyed hash: distinct and
the same everywhere, though without the format. So no collision is left.

Without such cases (the rule) surrogates are computed in place and texts are never shuffled;
else the redrawn ones are joined by text.

Edge cases: null stays null; empty texts and texts without entities are unchanged; repeated rows are equal after it;
ties between owners of a surrogate go to the earlier draw, then the least entity; very long texts are replaced
whole; an empty table gives an empty one. Columns may have any name: an added one that clashes gets underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import free_names, named, written

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Господин|Госпожа)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "account": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": rf"\b{_TITLE}\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Classes of characters, lower case: a character becomes another one of its class.
CLASSES = (
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "áéíóúàèìòùâêîôûäëïöüåæøœãõýÿ", "çñßšžčćłńśźżřďťňğş",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "ёйъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψς",
)
#: Draws of a surrogate before the placeholder is taken.
ROUNDS = 8


def _shift(key: str, kind: Column, before: Column, tweak: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, tweak.cast("string"), before), 256)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long")


def _pass(text: Column, kind: Column, tweak: Column, key: str) -> Column:
    """Each character of a class moves within it, by a keyed hash of the class characters before it."""

    def step(s: Column, c: Column) -> Column:
        low = F.lower(c)
        shift = _shift(key, kind, s["before"], tweak)
        moved = F.lit(None).cast("string")
        for letters in reversed(CLASSES):
            at = F.instr(F.lit(letters), low)
            moved = F.when((at > 0) & (low != ""), F.substring(F.lit(letters), (F.pmod(at - 1 + shift, F.lit(len(letters))) + 1).cast("int"), 1)).otherwise(moved)
        out = F.when(moved.isNull(), c).when((c != low), F.upper(moved)).otherwise(moved)
        return F.struct(F.when(moved.isNull(), s["before"]).otherwise(F.concat(s["before"], low)).alias("before"), F.concat(s["out"], out).alias("out"))

    start = F.struct(F.lit("").alias("before"), F.lit("").alias("out"))
    return F.aggregate(F.split(text, ""), start, step, lambda s: s["out"])


def _letters(body: Column, kind: Column, tweak: Column, key: str) -> Column:
    return F.reverse(_pass(F.reverse(_pass(body, kind, tweak, key + "/f")), kind, tweak, key + "/b"))


def _octets(ip: Column, tweak: Column, key: str) -> Column:
    def turn(parts: Column, label: str) -> Column:
        def step(s: Column, x: Column) -> Column:
            y = F.pmod(x.cast("int") + _shift(key + label, F.lit("ip"), s["before"], tweak), F.lit(256)).cast("string")
            return F.struct(F.concat(s["before"], F.lit("."), x).alias("before"), F.concat(s["out"], F.array(y)).alias("out"))

        return F.aggregate(parts, F.struct(F.lit("").alias("before"), F.expr("cast(array() as array<string>)").alias("out")), step, lambda s: s["out"])

    return F.array_join(F.reverse(turn(F.reverse(turn(F.split(ip, r"\."), "/f")), "/b")), ".")


def _luhn(digits: Column) -> Column:
    """Check-sum of 16 digits."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x) % 10


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def norm_of(entity: Column, kind: Column) -> Column:
    """What mentions of one entity share."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, "[^0-9]", "")).when(kind == "account", F.translate(entity, " ", "")).otherwise(F.lower(entity))


def placeholder(entity: Column, kind: Column, key: str) -> Column:
    """What an entity becomes whose format has no free surrogate: its kind and a keyed hash, so distinct and the same everywhere."""
    return F.concat(F.lit("<"), kind, F.lit("-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, norm_of(entity, kind)), 256), 1, 24), F.lit(">"))


def _part(part: Column, tweak: Column, key: str) -> Column:
    """A part of a name, but for its last letter."""
    return F.concat(_letters(F.substring(part, F.lit(1), F.length(part) - 1), F.lit("name"), tweak, key), F.right(part, F.lit(1)))


def surrogate(entity: Column, kind: Column, tweak: Column, key: str) -> Column:
    """tweak: the number of the draw; below 0 for the placeholder."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    # Of a card number all but the last digit move; the last one restores the check-sum's residue.
    card = _letters(F.regexp_replace(entity, "[0-9]$", ""), F.lit("card"), tweak, key)
    bare = F.concat(F.regexp_replace(card, "[^0-9]", ""), F.lit("0"))
    fixed_card = F.concat(card, F.pmod(_luhn(digits) - _luhn(bare), F.lit(10)).cast("string"))
    head = F.when(kind == "phone", F.regexp_extract(entity, r"^\+?[0-9]?", 0)).when(kind == "account", F.substring(entity, 1, 2)).when(kind == "name", F.regexp_extract(entity, rf"^{_TITLE}\.? ", 0)).otherwise(F.lit(""))
    tail = F.when(kind == "email", F.regexp_extract(entity, r"\.[A-Za-z]{2,}$", 0)).otherwise(F.lit(""))
    middle = F.substring(entity, F.length(head) + 1, F.length(entity) - F.length(head) - F.length(tail))
    rest = F.concat(head, _letters(middle, kind, tweak, key), tail)
    parts = F.transform(F.split(middle, " "), lambda w: _part(w, tweak, key))
    rest = F.when(kind == "name", F.concat(head, F.array_join(parts, " "))).otherwise(rest)
    return F.when(tweak < 0, placeholder(entity, kind, key)).when(kind == "ip", _octets(entity, tweak, key)).when(kind == "card", fixed_card).otherwise(rest)


#: What begins a title; a name has one of these.
SIGNS = ("Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Господин", "Госпожа")


def entities_of(text: Column) -> Column:
    """Entities in order. Every pattern needs a digit, an at sign or a title, which are looked for first, since that is cheap."""
    some = text.rlike("[0-9@]")
    for sign in SIGNS:
        some = some | text.contains(sign)
    return F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).when(text.isNotNull(), F.expr("cast(array() as array<string>)"))


def redrawn(docs: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """kind, norm, tweak of the entities whose first surrogate collides; -1 for those that collide in every round."""
    spark = docs.sparkSession
    found = docs.select(F.explode(F.array_distinct(entities_of(F.col("text")))).alias("e")).distinct()
    found = found.withColumn("kind", kind_of(F.col("e"))).withColumn("norm", norm_of(F.col("e"), F.col("kind")))
    now = found.groupBy("kind", "norm").agg(F.min("e").alias("e")).withColumn("tweak", F.lit(0))
    for k in range(rounds):
        now = now.withColumn("s", norm_of(surrogate(F.col("e"), F.col("kind"), F.col("tweak"), key), F.col("kind")))
        now = written(now, spark)
        real = now.select("kind", F.col("norm").alias("s"), F.lit(True).alias("real"))
        owner = now.groupBy("kind", "s").agg(F.min(F.struct("tweak", "norm")).alias("owner"))  # the first draw keeps a surrogate
        judged = now.join(real, ["kind", "s"], "left").join(owner, ["kind", "s"])
        bad = F.coalesce("real", F.lit(False)) | (F.col("owner.norm") != F.col("norm"))
        judged = written(judged.select("kind", "norm", "e", "tweak", bad.alias("bad")), spark)
        if judged.where("bad").isEmpty():
            break
        again = F.col("tweak") + 1 if k + 1 < rounds else F.lit(-1)
        now = judged.select("kind", "norm", "e", F.when(F.col("bad"), again).otherwise(F.col("tweak")).alias("tweak"))
    return now.where("tweak <> 0").select("kind", "norm", "tweak")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """docs with entities of text replaced, and n_entities. key: the caller's secret; who has it can undo the surrogates."""
    texts = docs.select("text")
    again = written(redrawn(texts, key), docs.sparkSession)
    held = docs.select(F.struct(*named(docs)).alias("r")).withColumn("text", F.col("r.text"))
    with_tweaks = held.withColumn("tweaks", F.expr("cast(null as map<string, int>)"))
    if not again.isEmpty():
        keys = {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), F.col("text"))}
        used = texts.withColumns(keys).select("t1", "t2", F.explode(F.array_distinct(entities_of(F.col("text")))).alias("e")).distinct()
        used = used.withColumn("kind", kind_of(F.col("e"))).withColumn("norm", norm_of(F.col("e"), F.col("kind"))).join(again, ["kind", "norm"])
        maps = used.groupBy("t1", "t2").agg(F.map_from_entries(F.collect_list(F.struct("e", "tweak"))).alias("tweaks"))  # entities of one text
        with_tweaks = held.withColumns(keys).join(maps, ["t1", "t2"], "left")

    def told(e: Column) -> Column:
        return F.struct(e.alias("e"), kind_of(e).alias("kind"), F.coalesce(F.get(F.map_values(F.map_filter("tweaks", lambda k, _: k == e)), F.lit(0)), F.lit(0)).alias("tweak"))

    found = with_tweaks.withColumn("e", F.transform(entities_of(F.col("text")), told))
    new = F.transform("e", lambda x: surrogate(x["e"], x["kind"], x["tweak"], key))
    # Later mentions of a name's parts alone, outside the entities.
    people = F.filter("e", lambda x: (x["kind"] == "name") & (x["tweak"] >= 0))
    parts = F.flatten(F.transform(people, lambda x: F.transform(F.split(F.regexp_replace(x["e"], rf"^{_TITLE}\.? ", ""), " "), lambda w: F.struct(w.alias("w"), _part(w, x["tweak"], key).alias("s")))))

    def renamed(piece: Column) -> Column:
        return F.aggregate(F.array_distinct(parts), piece, lambda t, p: F.when(t.contains(p["w"]), F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}'’-])\Q"), p["w"], F.lit(r"\E(?![\p{L}-])")), p["s"])).otherwise(t))

    between = F.split("text", ANY, -1)
    between = F.when(F.exists("e", lambda x: x["kind"] == "name"), F.transform(between, renamed)).otherwise(between)
    pieces = F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.size("e") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    n = F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(F.size("e")), F.lit(0)).cast("long")
    done = found.select("r", text.alias("new"), n.alias("n"))
    return done.select(*named(docs, "r", {"text": F.col("new")}), F.col("n").alias(free_names(docs.columns, ["n_entities"])["n_entities"]))
