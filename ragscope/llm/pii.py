"""Surrogates for personal data, with DataFrame functions only.

Entities are found by expressions, reduced to a canonical form (so that one number written in two ways is one
entity), and every distinct entity of the whole input gets one surrogate from a keyed hash: digits stay digits, letters
stay letters of the same script and case, lengths and separators stay, first names keep the gender of their title, card
numbers their check digit's validity and addresses their ranges. A name's surname and first name are entities of their own, so
that a person keeps one surname whatever the title and however much of the name a text gives; titles stay as written. Names
without one of the known titles are not found. Distinct entities that drew the same surrogate, or one that
is itself an entity of the input, draw again until none is left; from the fourth draw on a surrogate grows by a character
a draw, so that short forms never run out. Mentions then get their entity's surrogate in their own format.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = r"(?:Mr|Mrs|Ms|Herr|Frau|Mme|Sr|Sra|Господин|Госпожа)"
#: Kinds in the order in which they are tried at a place.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w)",
    "card": r"(?<!\w)(?:\d{4}[ -]?){3}\d{4}(?!\w)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?<!\w){_TITLE}\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
_ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A cheap necessary condition, so that most texts are searched once.
_HINT = rf"@|\d[\d. ()+-]{{5,}}\d|[A-Z]{{2}}\d\d|{_TITLE}\.? "
_FEMALE = "Mrs|Ms|Frau|Mme|Sra|Госпожа"
#: First names that take the place of others, by script and gender.
FIRST_NAMES = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia"],
    ("latin", "m"): ["Adam", "Daniel", "David", "Felix", "Hugo", "Leon", "Lucas", "Martin", "Oscar", "Thomas"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Мария", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Иван", "Олег", "Павел"],
    ("greek", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Πέτρος", "Σπύρος"],
    ("armenian", "f"): ["Աննա", "Մարիամ", "Նարե"],
    ("armenian", "m"): ["Արամ", "Դավիթ", "Տիգրան"],
}
#: Letters that a surrogate of a script grows by.
_GROWTH = {"cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ", "armenian": "աբգդեզէըթժիլխծկհ", "latin": "abcdefghijklmnop"}
_ALPHABETS = [("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
              (r"(?=\p{IsCyrillic})\p{Ll}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"(?=\p{IsCyrillic})\p{Lu}", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
              (r"(?=\p{IsGreek})\p{Ll}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"(?=\p{IsGreek})\p{Lu}", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
              (r"(?=\p{IsArmenian})\p{Ll}", "աբգդեզէըթժիլխծկհձղճմ"), (r"(?=\p{IsArmenian})\p{Lu}", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄ"),
              (r"\p{Ll}", "áàâäéèêëíîïñóôöúùûüç"), (r"\p{Lu}", "ÁÀÂÄÉÈÊËÍÎÏÑÓÔÖÚÙÛÜÇ")]


def _script(name: Column) -> Column:
    out = F.lit("latin")
    for script in ("Armenian", "Greek", "Cyrillic"):
        out = F.when(name.rlike(rf"\p{{Is{script}}}"), script.lower()).otherwise(out)
    return out


def _kind(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _canonical(kind: Column, mention: Column) -> Column:
    return (F.when(kind.isin("card", "ssn"), F.regexp_replace(mention, r"\D", "")).when(kind == "phone", F.regexp_replace(mention, r"[^0-9+]", ""))
            .when(kind == "email", F.lower(mention)).when(kind == "iban", F.regexp_replace(mention, " ", "")).otherwise(mention))


#: A name with title and period, first name or none, surname, and what the surname is followed by.
_NAME = rf"^({_TITLE}\.? )(?:([^ ]+) )?([^ ]+?)((?:'s)?)$"


def _parts(kind: Column, mention: Column) -> Column:
    """Kind and entity of what a mention is made of: a name's first name and surname, all else is one part."""
    part = lambda k, e: F.struct(k.alias("part"), e.alias("entity"))
    script = _script(F.regexp_extract(mention, _NAME, 2))
    gender = F.when(mention.rlike(rf"^(?:{_FEMALE})\.? "), "f").otherwise("m")
    given = F.regexp_extract(mention, _NAME, 2)
    first = F.array_join(F.transform(F.split(given, "-"), lambda x: F.initcap(x)), "-")
    surname = part(F.lit("surname"), F.lower(F.regexp_extract(mention, _NAME, 3)))
    names = F.when(given == "", F.array(surname)).otherwise(F.array(part(F.lit("first"), F.concat_ws("|", gender, script, first)), surname))
    return F.when(kind == "name", names).otherwise(F.array(part(kind, _canonical(kind, mention))))


def _cased(mention: Column, surrogate: Column) -> Column:
    """The surrogate with capitals where the mention has them."""
    return F.array_join(F.transform(F.split(mention, "(?!^)"), lambda c, i: (lambda x: F.when(c.rlike(r"^\p{Lu}$"), F.upper(x)).otherwise(x))(
        F.substring(surrogate, i + 1, F.lit(1)))), "")


def _substituted(text: Column, digest: Column) -> Column:
    """Each character becomes another of its kind, picked by two hex digits of the keyed hash; longer texts use them again."""
    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(digest, (i % 62) * 2 + 1, F.lit(2)), 16, 10).cast("int") + (i / 62).cast("int")
        out = c
        for pattern, letters in reversed(_ALPHABETS):
            out = F.when(c.rlike(f"^{pattern}$"), F.substring(F.lit(letters), v % len(letters) + 1, F.lit(1))).otherwise(out)
        return out
    return F.array_join(F.transform(F.split(text, "(?!^)"), one), "")


def _luhn(digits: Column) -> Column:
    """The check digit's remainder of 15 digits."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda s, i: s + (
        lambda d: F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d))(F.substring(digits, i, F.lit(1)).cast("int"))) % 10


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal, with the key's pads as literals."""
    block = hashlib.sha256(key.encode()).digest().ljust(64, b"\0") if len(key.encode()) > 64 else key.encode().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _surrogate(kind: Column, entity: Column, key: str, draw: Column) -> Column:
    digest = F.concat(*[_hmac(key, F.concat_ws("|", F.lit(str(i)), kind, entity, draw.cast("string"))) for i in range(2)])
    # Characters that a surrogate grows by, one more a draw from the fourth on.
    hexes = F.substring(digest, F.lit(1), F.greatest(draw - 2, F.lit(0)))
    digits, letters = F.translate(hexes, "abcdef", "012345"), F.translate(hexes, "0123456789abcdef", _GROWTH["latin"])
    surname = F.lit(None).cast("string")
    for script, alphabet in _GROWTH.items():
        surname = F.when(_script(entity) == script, F.translate(hexes, "0123456789abcdef", alphabet)).otherwise(surname)
    value = lambda i: F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int")
    other = _substituted(entity, digest)
    last = lambda x: F.substring(x, 16, 1).cast("int")
    card = F.concat(F.substring(other, 1, 15), F.pmod(F.lit(10) - _luhn(other) + last(entity) + _luhn(entity), F.lit(10)).cast("string"))
    ip = F.concat_ws(".", *[(value(i) % (223 if i == 0 else 254) + 1).cast("string") for i in range(4)])
    domain = F.substring_index(other, "@", -1)
    email = F.concat(F.substring_index(other, "@", 1), letters, F.lit("@"),
                     F.regexp_replace(domain, r"\.[a-z]+$", ""), F.regexp_extract(entity, r"\.[a-z]+$", 0))
    phone = F.concat(F.regexp_extract(entity, r"^\+?[0-9]", 0), F.substring(other, F.length(F.regexp_extract(entity, r"^\+?[0-9]", 0)) + 1, F.lit(64)))
    iban = F.concat(F.substring(entity, 1, 2), F.substring(other, 3, 64))
    # a list name, then, draw by draw, compounds of one more
    first = F.lit(None).cast("string")
    for (script, gender), names in FIRST_NAMES.items():
        one = lambda i: F.get(F.array(*map(F.lit, names)), F.conv(F.substring(digest, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int") % len(names))  # noqa: B023, E731
        prefix = f"{gender}|{script}|"
        first = F.when(entity.startswith(prefix), F.concat(F.lit(prefix), F.array_join(F.transform(F.sequence(F.lit(0), draw), one), "-"))).otherwise(first)
    return (F.when(kind == "card", F.concat(card, digits)).when(kind == "ip", F.concat(ip, F.regexp_replace(digits, "(.)", r".$1")))
            .when(kind == "email", email).when(kind == "phone", F.concat(phone, digits)).when(kind == "ssn", F.concat(other, digits))
            .when(kind == "iban", F.concat(iban, F.upper(letters))).when(kind == "first", first).otherwise(F.concat(other, surname)))


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity) to (kind, entity, surrogate): distinct entities get distinct surrogates, none of which is an entity.

    Each round settles the entities whose draw is nobody else's, neither an entity nor settled before; of equal draws the
    smallest entity's stands. The others draw again, from a space that grows with each draw, so that the rest shrinks fast.
    Entities are dealt by their hash: the work is per character, and bytes say little about it.
    """
    n = max(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    entities = materialise(entities.select("kind", "entity").distinct().repartition(n, "kind", "entity"), "entities")
    settled, rest, draw = None, entities, 0
    while True:
        drawn = rest.withColumn("surrogate", _surrogate(F.col("kind"), F.col("entity"), key, F.lit(draw)))
        taken = entities.select("kind", F.col("entity").alias("surrogate"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "surrogate"))
        won = (drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
               .join(taken, ["kind", "surrogate"], "left_anti").select("kind", "entity", "surrogate"))
        now = materialise(won if settled is None else won.union(settled), "surrogates")
        left = materialise(rest.join(now.select("kind", "entity"), ["kind", "entity"], "left_anti"), "entities")
        if left.isEmpty():
            return now
        settled, rest, draw = now, left, draw + 1


def _filled(mention: Column, surrogate: Column, kept: str) -> Column:
    """The surrogate's characters in the places of the mention's, those that it has more at the end; separators stay."""
    places = F.length(F.regexp_replace(mention, kept, ""))
    more = F.substring(surrogate, F.length(mention) - places + 1, F.length(surrogate))
    return F.when(places == 0, surrogate).otherwise(F.concat(F.array_join(F.transform(F.split(mention, "(?!^)"), lambda c, i: F.when(
        c.rlike(f"^{kept}$"), F.substring(surrogate, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), f"(?!{kept}).", "")), F.lit(1))).otherwise(c)), ""), more))


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` is a secret: whoever has it can tell which surrogate an entity gets. All rows and columns of ``docs`` with ``text`` rewritten, and ``pii``: the number of replaced mentions per kind in
    the order of KINDS. Null and empty texts stay as they are, with zeros; repeated rows are rewritten alike, as is one entity in all
    documents; an empty table gives an empty result; a column of ``docs`` named pii is replaced.

    Only rows with a mention are moved: mentions join their entities' surrogates, a hot entity like any key of an equi-join,
    and come back together by row.
    """
    columns = [c for c in docs.columns if c != "pii"]
    zeros = F.array(*[F.lit(0).cast("long")] * len(KINDS))
    body = F.coalesce(F.col(text), F.lit(""))
    mentions = F.when(body.rlike(_HINT), F.regexp_extract_all(body, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # written whole, so that the expressions run once over each text
    rows = materialise(docs.select(F.struct(*columns).alias("row"), mentions.alias("mentions"), F.monotonically_increasing_id().alias("id")), "pii-rows")
    found = rows.where(F.size("mentions") > 0)
    each = (found.select("id", F.posexplode("mentions").alias("at", "mention")).withColumn("kind", _kind(F.col("mention")))
            .where("kind is not null").select("id", "at", "mention", "kind", F.posexplode(_parts(F.col("kind"), F.col("mention"))).alias("nth", "of"))
            .select("id", "at", "mention", "kind", "nth", F.col("of.part").alias("part"), F.col("of.entity").alias("entity")))
    surrogates = draw_surrogates(each.select(F.col("part").alias("kind"), "entity"), key).withColumnRenamed("kind", "part")
    mention, surrogate, kind = F.col("mention"), F.col("surrogate"), F.col("kind")
    piece = lambda i: F.regexp_extract(mention, _NAME, i)
    surname = F.concat(F.when(piece(2) == "", piece(1)).otherwise(F.lit(" ")), _cased(piece(3), surrogate), piece(4))
    written = (F.when(kind.isin("card", "ssn", "phone"), _filled(mention, F.regexp_replace(surrogate, r"\+", ""), "[0-9]"))
               .when(kind == "iban", _filled(mention, surrogate, "[A-Z0-9]"))
               .when(F.col("part") == "first", F.concat(piece(1), F.substring_index(surrogate, "|", -1))).when(F.col("part") == "surname", surname)
               .otherwise(surrogate))
    whole = (each.join(surrogates, ["part", "entity"]).groupBy("id", "at", "kind").agg(F.array_sort(F.collect_list(F.struct("nth", written.alias("new")))).alias("new"))
             .withColumn("new", F.array_join("new.new", "")))
    new = whole.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "new", "kind"))).alias("new"))
    pieces = F.split(F.col("row")[text], _ANY, -1)
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("new")["new"], i), F.lit("")))), "")
    of_kind = lambda k: F.size(F.filter("new", lambda n: n["kind"] == k)).cast("long")
    counts = F.array(*map(of_kind, KINDS))
    rewritten = found.join(new, "id").select(*[(joined if c == text else F.col("row")[c]).alias(c) for c in columns], counts.alias("pii"))
    same = rows.where(F.size("mentions") == 0).select("row.*", zeros.alias("pii"))
    return same.union(rewritten)


#: Setting that holds the key; without it a run draws a key of its own, and no two runs have the same surrogates.
KEY_SETTING = "spark.ragscope.pii.key"


def op8_surrogates(spark, sf_dir: str) -> DataFrame:
    out = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32))
    return out.select("doc_id", "text", *[F.col("pii")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)])
