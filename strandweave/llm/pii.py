"""Personal data replaced by surrogates, with DataFrame functions only.

Entities are found by pattern (with check digits where the kind has them) and
mapped corpus-wide: one entity has one surrogate wherever it stands, drawn by
a keyed hash within its kind, gender, script and format. Draws that two
entities share, or that name a real entity, are drawn again. A name found once
after a title is also found where it stands without one in the same text.

No pattern repeats a group without a small bound, so a match's depth doesn't
grow with the text, and each one tells by its first letter where it can't match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import join_once, let, stage, unstage

# fixed values: titles by gender, given names by gender and script, syllables by script
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Signora", "Dra", "госпожа", "г-жа")
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин", "г-н")
TITLES_N = ("Dr", "Prof", "Professor", "Доктор", "доктор", "д-р")
GIVEN = {
    "f:latin": ("Anna", "Clara", "Elena", "Greta", "Ines", "Julia", "Lena", "Maria", "Nora", "Vera"),
    "m:latin": ("Adam", "Bruno", "David", "Emil", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Victor"),
    "n:latin": ("Alex", "Chris", "Jona", "Kim", "Luca", "Noa", "Robin", "Sascha"),
    "f:cyrillic": ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    "m:cyrillic": ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Роман"),
    "n:cyrillic": ("Саша", "Женя", "Валя", "Слава"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fi", "gor", "hal", "kin", "lo", "mar", "ne", "por", "ras", "sel", "tan", "vi", "wer", "zo"),
    "cyrillic": ("ба", "ден", "фи", "гор", "хал", "кин", "ло", "мар", "не", "пор", "рас", "сел", "тан", "ви", "вер", "зо"),
}
ENDINGS = {"f:latin": "ina", "m:latin": "an", "n:latin": "is", "s:latin": "", "f:cyrillic": "ина", "m:cyrillic": "ан", "n:cyrillic": "ис", "s:cyrillic": ""}
#: Country calling codes of one and two digits; all others have three.
COUNTRIES = r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_SEP = r"[^\p{L}\p{N}\n@+]{1,6}"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++\.[\p{L}\p{N}.-]*[\p{L}\p{N}]"
_PHONE = (
    rf"(?<![\p{{N}}+])(?:\+\d{{7,15}}|\+\d{{1,3}}{_SEP}\d{{1,4}}(?:{_SEP}\d{{2,4}}){{2,4}}|\+\d{{1,3}}{_SEP}(?:\d{{1,5}}{_SEP})?\d{{4,12}}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)"
)
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\p{L}\p{N}.])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])"
_NUMBER = rf"(?=[+(0-9])(?:{_IP}|{_PHONE}|{_SSN}|{_CARD})"
_WORD = r"\p{Lu}[\p{L}'’-]++"


@dataclass(frozen=True)
class Surrogates:
    """Parameters: the key decides every draw; from the ``draws``-th on, draws are longer than the format, so that none runs out.

    Names are found after the titles; ``given`` are the names to draw from, by gender and script.
    """

    key: str = "surrogate-key"
    draws: int = 8
    titles_f: tuple[str, ...] = TITLES_F
    titles_m: tuple[str, ...] = TITLES_M
    titles_n: tuple[str, ...] = TITLES_N
    given: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(GIVEN))

    @cached_property
    def name(self) -> str:
        """A title and up to five words or initials."""
        titles = sorted({*self.titles_f, *self.titles_m, *self.titles_n}, key=lambda t: (-len(t), t))
        if not titles:
            return r"(?!)"
        first = "".join(sorted({re.escape(t[0]) for t in titles}))
        return rf"(?=[{first}])(?<!\p{{L}})(?:{'|'.join(map(re.escape, titles))})\.? {_WORD}(?: (?:{_WORD}|\p{{Lu}}\.)){{0,4}}"

    @cached_property
    def mention(self) -> str:
        return "|".join((_EMAIL, _NUMBER, self.name))


_PIECE = "array<struct<lit:string,kind:string,canon:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last of them the check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _kind(m: Column) -> Column:
    """The kind of a mention other than a name; null for what only looks like one."""
    octets = F.forall(F.split(m, r"\."), lambda o: F.coalesce(F.expr("1") * o.try_cast("int"), F.lit(999)) <= 255)
    return (
        F.when(F.contains(m, F.lit("@")), F.when(m.rlike(r"@[^.]+\.[^.]"), "email"))
        .when(m.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), F.when(octets, "ip"))
        .when(m.rlike(rf"^(?:{_PHONE})$"), "phone")
        .when(m.rlike(rf"^(?:{_SSN})$"), "ssn")
        .when(m.rlike(r"^\d"), F.when(_luhn_sum(_digits(m)) % 10 == 0, "card"))
    )


def _canonical(kind: Column, m: Column) -> Column:
    """What mentions of one entity share: a phone number is its digits, with the country's code apart from the rest."""
    digits = _digits(m)
    country = F.when(F.startswith(m, F.lit("+")), F.regexp_extract(digits, rf"^(?:{COUNTRIES}|\d{{3}})", 0)).otherwise("")
    return F.when(kind == "email", F.lower(m)).when(kind == "phone", F.concat(country, F.lit("|"), F.substring(digits, F.length(country) + 1, F.lit(99)))).when(kind == "ip", m).otherwise(digits)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _piece(lit: Column, kind: Column | None = None, canon: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(lit.alias("lit"), (none if kind is None else kind).alias("kind"), (none if canon is None else canon).alias("canon"))


def _title(m: Column) -> Column:
    """The title of a mention of a name, with the space behind it; empty where there is none."""
    return F.regexp_extract(m, r"^(\S+ )", 1)


def _gender(title: Column, p: Surrogates) -> Column:
    bare = F.rtrim(F.replace(title, F.lit(".")))
    return F.when(bare.isin(*p.titles_f), "f").when(bare.isin(*p.titles_m), "m")


def _listed(word: Column, p: Surrogates) -> Column:
    """The gender of a lower-cased given name by the lists; n if they don't tell."""
    known = {g: [n.lower() for who, names in p.given.items() if who[0] == g for n in names] for g in "fm"}
    return F.when(word.isin(*known["f"]), "f").when(word.isin(*known["m"]), "m").otherwise("n")


def _name_parts(m: Column, titled: Column, genders: Column, p: Surrogates) -> Column:
    """A name's pieces: title, given names, surname. A given name has the gender that a title before it in the text tells."""
    title = F.when(titled, _title(m)).otherwise("")
    words = F.split(F.substring(m, F.length(title) + 1, F.lit(2_000_000_000)), " ")
    first = F.lower(F.get(words, F.lit(0)))
    gender = F.coalesce(F.try_element_at(genders, first), _listed(first, p))
    last = F.size(words) - 1

    def word(w: Column, i: Column) -> Column:
        initial = w.rlike(r"^\p{Lu}\.$")
        who = F.when(i == last, "s").otherwise(gender)
        kind = F.when(initial, None).otherwise(F.concat(F.lit("given:"), who, F.lit(":"), _script(w)))
        drawn = F.concat(_letters(F.left(w, F.lit(1)), F.sha2(F.concat(F.lit(p.key), w), 256), F.lit(0)), F.lit("."))
        return F.array(_piece(F.when(i == 0, "").otherwise(" ")), _piece(F.when(initial, drawn).otherwise(w), kind, F.when(~initial, F.lower(w))))

    return F.concat(F.array(_piece(title)), F.flatten(F.transform(words, word)))


def _plain_parts(m: Column) -> Column:
    """The pieces of a mention other than a name. What follows two dots isn't of an address."""
    core = F.when(F.contains(m, F.lit("@")), F.substring_index(m, "..", 1)).otherwise(m)
    kind = _kind(core)
    rest = F.substring(m, F.length(core) + 1, F.lit(2_000_000_000))
    return F.when(kind.isNotNull(), F.array(_piece(core, kind, _canonical(kind, core)), _piece(rest))).otherwise(F.array(_piece(m)))


def _hash_at(h: Column, i: Column, size: int) -> Column:
    """A number under ``size`` from the i-th byte pair of a hex digest, going round."""
    return (F.conv(F.substring(h, F.pmod(i, F.lit(30)) * 2 + 1, F.lit(4)), 16, 10).cast("int") + i) % size


def _letters(c: Column, h: Column, i: Column) -> Column:
    """A character of the same class and script."""
    pick = lambda s: F.substring(F.lit(s), _hash_at(h, i, len(s)) + 1, F.lit(1))
    return (
        F.when(c.rlike("[0-9]"), pick("0123456789"))
        .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
        .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(c.rlike(r"^[А-ЯЁ]"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
        .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя"))
        .when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω"))
        .when(c.rlike(r"\p{IsLatin}"), pick("áàâäéèêëíîïóôöúùûüñç"))
        .when(c.rlike(r"\p{L}"), pick("一二三四五六七八九十上下大小中人山水木火"))
        .otherwise(c)
    )


def _shaped(s: Column, h: Column) -> Column:
    """``s`` with each letter and digit replaced by one of its class; ``h`` must be a value that is computed once."""
    return F.array_join(F.transform(F.split(s, ""), lambda c, i: _letters(c, h, i)), "")


def _random_digits(h: Column, n: Column) -> Column:
    return F.when(n <= 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: _hash_at(h, i, 10).cast("string")), ""))


def _draw(p: Surrogates, kind: Column, canon: Column, attempt: int) -> Column:
    """The surrogate of an entity at an attempt, in canonical form; late attempts have digits or letters more."""
    late = attempt >= p.draws
    more = 12 if late else 0
    domain = F.substring_index(canon, "@", -1)
    host = F.sha2(F.concat_ws("\x1f", F.lit(p.key), F.lit("host"), domain), 256)

    def drawn(h: Column) -> Column:
        longer = F.translate(F.substring(h, 33, 12), "0123456789", "ghijklmnop") if late else F.lit("")
        email = F.concat(_shaped(F.substring_index(canon, "@", 1), h), longer, F.lit("@"), let(host, lambda g: _shaped(F.substring_index(domain, ".", 1), g)), F.lit(".example."), F.substring_index(domain, ".", -1))
        phone = F.concat(F.substring_index(canon, "|", 1), F.lit("|"), _random_digits(h, F.length(F.substring_index(canon, "|", -1)) + more))
        ip = F.concat_ws(".", (_hash_at(h, F.lit(0), 223) + 1).cast("string"), *[_hash_at(h, F.lit(k), 256).cast("string") for k in (3, 6, 9)])
        card = let(F.concat(F.substring(canon, 1, 1), _random_digits(h, F.length(canon) - 2 + more)), lambda body: F.concat(body, F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))
        ssn = F.concat(F.lit("9"), _random_digits(h, F.length(canon) - 1 + more))
        out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", card).when(kind == "ssn", ssn)
        for who, ending in ENDINGS.items():
            syllables = F.array(*map(F.lit, SYLLABLES[who[2:]]))
            # later attempts draw longer names, so a list can't run out
            size = 2 + (attempt > 2) + (attempt > 4) + 2 * late
            made = F.concat(*[F.element_at(syllables, _hash_at(h, F.lit(5 * k), 16) + 1) for k in range(size)], F.lit(ending))
            names = p.given.get(who)
            if names and attempt == 0:
                made = F.element_at(F.array(*[F.lit(n.lower()) for n in names]), _hash_at(h, F.lit(0), len(names)) + 1)
            out = out.when(kind == f"given:{who}", made)
        return out

    return let(F.sha2(F.concat_ws("\x1f", F.lit(p.key), kind, canon, F.lit(str(attempt))), 256), drawn)


def surrogate_map(entities: DataFrame, p: Surrogates = Surrogates()) -> DataFrame:
    """``entities(kind, canon)`` to (kind, canon, surrogate, times): distinct entities of a kind get distinct
    surrogates, none of which is an entity itself; times, how many rows name the entity.

    Draws go on until none clash, from the ``draws``-th in longer forms; if four times as many don't suffice, this raises.
    """
    known = stage(entities.where("kind is not null and canon is not null").groupBy("kind", "canon").agg(F.count("*").alias("times")), "entities")
    real = known.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
    now = stage(known.withColumn("surrogate", _draw(p, F.col("kind"), F.col("canon"), 0)), "surrogates")
    for attempt in range(1, 4 * p.draws + 1):
        first = now.groupBy("kind", "surrogate").agg(F.min("canon").alias("winner"))
        marked = now.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        clash = (F.col("canon") != F.col("winner")) | F.col("real").isNotNull()
        marked = stage(marked.select("kind", "canon", "times", "surrogate", clash.alias("clash")), "surrogates")
        unstage(now)
        now = marked
        if not now.where("clash").take(1):
            return now.drop("clash")
        again = F.when(F.col("clash"), _draw(p, F.col("kind"), F.col("canon"), attempt)).otherwise(F.col("surrogate"))
        now = stage(now.select("kind", "canon", "times", again.alias("surrogate")), "surrogates")
        unstage(marked)
    raise RuntimeError("a kind of entity has more members than its format has surrogates")


def _spelled(kind: Column, m: Column, surrogate: Column) -> Column:
    """A surrogate in the format of the mention: its separators, or its capitals."""
    def filled(digits: Column) -> Column:
        """The digits take the places of the mention's digits; those that are left follow."""
        return F.aggregate(
            F.split(m, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
            lambda a, c: F.struct(
                F.concat(a["out"], F.when(c.rlike("[0-9]"), F.substring(digits, a["k"], F.lit(1))).otherwise(c)).alias("out"),
                (a["k"] + c.rlike("[0-9]").cast("int")).alias("k"),
            ),
            lambda a: F.concat(a["out"], F.substring(digits, a["k"], F.lit(99))),
        )

    capitals = F.when((m == F.upper(m)) & (m != F.lower(m)), F.upper(surrogate)).otherwise(surrogate)
    named = F.when((m == F.upper(m)) & (F.length(m) > 1), F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
    return F.when(kind == "email", capitals).when(kind == "ip", surrogate).when(F.startswith(kind, F.lit("given")), named).otherwise(let(F.regexp_replace(surrogate, r"\D", ""), filled))


def _cut(rows: DataFrame, p: Surrogates) -> DataFrame:
    """``rows(__text, ...)`` with ``__pieces``: the text's pieces in order, those that are entities with kind and canon."""
    titled = F.lit(rf"^(?:{p.name})$")
    # titles first: what they name is looked for without a title too
    named = F.when(F.col("__text").rlike(p.name), F.regexp_extract_all("__text", F.lit(p.name), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__named", named)
    whole = F.array_distinct(F.filter(F.transform("__named", lambda m: F.substring(m, F.length(_title(m)) + 1, F.lit(2_000_000_000))), lambda w: F.contains(w, F.lit(" "))))
    told = F.filter(F.transform("__named", lambda m: F.struct(F.lower(F.get(F.split(m, " "), F.lit(1))).alias("name"), _gender(_title(m), p).alias("gender"))), lambda g: g["gender"].isNotNull())
    # one gender a name, the smaller letter where titles differ
    genders = let(F.array_sort(F.array_distinct(told)), lambda gs: F.map_from_entries(F.filter(gs, lambda g, i: (i == 0) | (F.get(gs, i - 1)["name"] != g["name"]))))
    # longer names first, so that none is cut short by another; names hold letters, points, quotes and hyphens only
    longest = F.transform(F.array_sort(F.transform(whole, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: F.replace(x["w"], F.lit("."), F.lit("\\.")))
    bare = F.when(F.size(whole) > 0, F.concat(F.lit(p.mention + r"|(?=\p{Lu})(?<!\p{L})(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(p.mention))
    rows = rows.withColumns({"__bare": bare, "__genders": genders})
    # two branches, so that texts without names meet a constant pattern
    some = F.size("__named") > 0
    gaps = F.when(some, F.split("__text", F.col("__bare"), -1)).otherwise(F.split("__text", p.mention, -1))
    found = F.when(some, F.regexp_extract_all("__text", F.col("__bare"), F.lit(0))).otherwise(F.regexp_extract_all("__text", F.lit(p.mention), F.lit(0)))
    rows = rows.withColumns({"__gaps": gaps, "__found": found})

    def parts(g: Column, m: Column) -> Column:
        after_title = F.regexp_like(m, titled)
        is_name = after_title | m.rlike(rf"^{_WORD} ")
        told = F.when(m.isNull(), F.array().cast(_PIECE)).when(is_name, _name_parts(m, after_title, F.col("__genders"), p)).otherwise(_plain_parts(m))
        return F.concat(F.array(_piece(g)), told)

    pieces = F.filter(F.flatten(F.zip_with("__gaps", "__found", parts)), lambda x: x["lit"] != "")
    return rows.withColumn("__pieces", pieces).drop("__named", "__bare", "__genders", "__gaps", "__found")


def replaced(docs: DataFrame, p: Surrogates = Surrogates(), text_col: str = "text", count_col: str = "n_replaced") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and ``count_col``, how many mentions.

    Kinds: e-mail addresses, telephone numbers, IPv4 addresses, payment card
    numbers that pass the Luhn check, social security numbers, and names after
    a title, up to five words; such a name of two words and more is replaced
    wherever it stands in the text. Of a name each word counts as a mention.
    All else stays as it is: numbers that fail their check, null texts (count
    0), empty texts and other columns. Very long texts and mentions are read whole.
    Mentions that overlap go to the one that begins first; of those, to the
    kind named first above. Rows repeat and ids may be null. A column named as
    ``count_col`` is replaced. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != count_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    text = F.col(f"`{text_col}`")
    has = F.coalesce((F.contains(text, F.lit("@")) & text.rlike(_EMAIL)) | text.rlike(f"{_NUMBER}|{p.name}"), F.lit(False))
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != text_col], F.lit(0).alias("__none"))
    marked = docs.where(has).select(F.monotonically_increasing_id().alias("__row"), rest.alias("__rest"), text.alias("__text"))
    marked = stage(_cut(marked, p).select("__row", "__rest", "__pieces"), "pieces")

    each = marked.select("__row", F.posexplode("__pieces").alias("__at", "__p")).where("__p.kind is not null")
    each = stage(each.select("__row", "__at", "__p.lit", "__p.kind", "__p.canon"), "mentions")
    mapping = surrogate_map(each, p)
    told = join_once(each, mapping, ["kind", "canon"], "times", each.count())
    told = told.select("__row", F.struct("__at", _spelled(F.col("kind"), F.col("lit"), F.col("surrogate")).alias("w")).alias("x"))
    of_row = told.groupBy("__row").agg(F.collect_list("x").alias("__new"), F.count("*").alias(count_col))
    whole = marked.join(of_row, "__row", "left")
    fixed = F.filter(F.transform("__pieces", lambda x, i: F.when(x["kind"].isNull(), F.struct(i.alias("__at"), x["lit"].alias("w")))), lambda x: x.isNotNull())
    words = F.transform(F.array_sort(F.concat(fixed, F.coalesce("__new", F.array().cast("array<struct<__at:int,w:string>>")))), lambda x: x["w"])
    changed = whole.select(*[F.array_join(words, "").alias(c) if c == text_col else F.col(f"__rest.`{c}`").alias(c) for c in names], F.coalesce(F.col(count_col), F.lit(0).cast("long")).alias(count_col))
    same = docs.where(~has).withColumn(count_col, F.lit(0).cast("long"))
    return same.unionByName(changed)
