"""Surrogates for personal data, with DataFrame functions only.

Entities are found by pattern and checked (card checksum, address range). Each
consists of units, which are what must stay the same and stay apart: the name
and the domain of an e-mail address, the digits of a phone number, each word of
a person's name. A unit's surrogate is drawn from a SHA-256 stream of the key,
the unit's kind and its normal form, so every mention in any document gets the
same one; separators, letter case, script and lengths follow the mention, and
given names keep their gender.

All distinct units of the corpus are checked: a surrogate that two units
share, or that is itself a unit of the corpus, is drawn again for all but one of them,
until none is left. First draws need no lookup; only units drawn again do.
A text is searched twice: once for its mentions, which are written with its key,
and once when it is changed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, row_of, text_key, written

LETTER, ALNUM = r"\p{L}\p{M}", r"\p{L}\p{M}\p{N}"
#: Titles by gender (fixed values).
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "κύριος", "κ"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Signora", "г-жа", "госпожа", "κυρία", "κα"],
    "u": ["Dr", "Prof"],
}
TITLES = {g: [*ts, *(t[0].upper() + t[1:] for t in ts if t[0].islower())] for g, ts in TITLES.items()}
# in capitals too, but for those that are also abbreviations of other things
TITLES = {g: [*ts, *(t.upper() for t in ts if len(t) > 3 or t in ("Mr", "Mrs"))] for g, ts in TITLES.items()}
TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
HEX = "[0-9A-Fa-f]{1,4}"
KEYWORD = "(?i:password|passwd|token|secret|api_?key)"
#: What a secret after a keyword consists of; one below eight characters has a digit.
SECRET = r"[A-Za-z0-9_\-@!#$%^*+/~]"
#: A signed token: two or three parts in base64, the first an object.
SIGNED = r"eyJ[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]{4,}+){1,2}"
#: In the order in which they are tried at a place of the text.
PATTERNS = {
    "email": rf"(?<![{ALNUM}._%+\-])[{ALNUM}._%+\-]++@[{ALNUM}\-]++(?:\.[{ALNUM}\-]++)*(?<=\.[{LETTER}]{{2,24}})",
    # four numbers after a v or the word version are no address
    "ip": r"(?<![\p{L}\p{N}._])(?=[0-9]{1,3}\.)(?<!(?i:version|release)[ :=]{1,3})(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ip6": rf"(?<![{ALNUM}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![{ALNUM}:])",
    "iban": rf"(?<![{ALNUM}])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{ALNUM}])",
    # sixteen, fifteen and fourteen digits as they are printed on cards, then any; not with a short number before them
    "card": rf"(?<![{ALNUM}])(?:[0-9]{{4}}(?:[ \-]?[0-9]{{4}}){{3}}|[0-9]{{4}}[ \-]?[0-9]{{6}}[ \-]?[0-9]{{4,5}}|(?![0-9]{{1,3}}[ \-](?:[0-9]{{4}}[ \-]?){{3}}[0-9])[0-9](?:[ \-]?[0-9]){{12,18}})(?![{ALNUM}])",
    "ssn": rf"(?<![{ALNUM}])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![{ALNUM}])",
    "phone": rf"(?<![{ALNUM}+])(?:\+?[0-9]{{1,3}}[ .\-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[ .\-]?[0-9]{{3,4}}[ .\-][0-9]{{3,4}}|\([0-9]{{3}}\)[ .\-]?[0-9]{{3}}[ .\-][0-9]{{4}})(?![{ALNUM}])",
    # one character is looked back at first, as few places follow a keyword
    "secret": rf"(?<![{ALNUM}]){SIGNED}(?![{ALNUM}])|(?<=[=:： \"'])(?<={KEYWORD}[ ]{{0,3}}[=:：][ ]{{0,3}}[\"']?)(?:{SECRET}{{8,}}+|(?={SECRET}{{0,6}}[0-9]){SECRET}{{6,7}}+)|(?<![{ALNUM}])AKIA[0-9A-Z]{{16}}(?![{ALNUM}])",
    "person": rf"(?<![{ALNUM}])(?:{TITLE})\.? \p{{Lu}}[{LETTER}'’\-]+(?: \p{{Lu}}[{LETTER}'’\-]+){{0,2}}",
}
ENTITY = "|".join(PATTERNS.values())
#: What a text without any of these cannot hold.
HINT = rf"[0-9]|@|{KEYWORD}|AKIA|eyJ|(?:{TITLE})\.? "
#: Names by gender and script (fixed values); others are made of syllables or letters.
GIVEN = {
    "m": {"latin": "Adam Brian Carl David Edgar Felix Gerald Henry Isaac Jonas Kevin Lukas Martin Noel Oscar Peter Quentin Robert Simon Thomas Ulrich Victor Walter Xavier", "cyrillic": "Андрей Борис Виктор Григорий Дмитрий Егор Игорь Кирилл Леонид Максим Никита Олег Павел Роман Сергей Тимур", "greek": "Ανδρέας Βασίλης Γιώργος Δημήτρης Κώστας Λεωνίδας Νίκος Πέτρος Σταύρος Χρήστος"},
    "f": {"latin": "Alice Bianca Clara Diana Emma Fiona Greta Helen Irene Julia Karen Laura Maria Nora Olivia Paula Queenie Rosa Sarah Teresa Ursula Vera Wendy Yvonne", "cyrillic": "Анна Вера Галина Дарья Елена Зоя Ирина Клара Лидия Мария Нина Ольга Полина Софья Тамара Юлия", "greek": "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Κατερίνα Λυδία Μαρία Σοφία Χριστίνα"},
    "u": {"latin": "Alex Blake Casey Drew Ellis Finley Harper Jamie Kim Logan Morgan Noa Quinn Robin Sasha Toni", "cyrillic": "Саша Женя Валя Слава Шура Паша", "greek": "Άλεξ Χάρης Φώτης Δάφνη"},
}
FAMILY = {"latin": "Abbott Barker Carver Dalton Ericson Farmer Garner Harris Ingram Jarvis Keller Lawson Mercer Norris Osborn Parker Quincy Ramsey Sawyer Turner Upton Vaughn Walker Yates", "cyrillic": "Антонов Борисов Власов Громов Данилов Ефимов Зайцев Ильин Козлов Лебедев Марков Новиков Орлов Павлов Романов Соколов", "greek": "Αντωνίου Βλάχος Γεωργίου Δήμου Ιωάννου Κωνσταντίνου Μακρής Νικολάου Παππάς Σταύρου"}
#: Letters of each script, by code.
ALPHABET = {
    "latin": string.ascii_lowercase,
    "cyrillic": "".join(map(chr, range(0x430, 0x450))),
    "greek": "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2),
    "hebrew": "".join(map(chr, range(0x5D0, 0x5EB))),
    "arabic": "".join(map(chr, range(0x628, 0x63B))),
    "devanagari": "".join(map(chr, range(0x915, 0x939))),
    "hiragana": "".join(map(chr, range(0x304B, 0x3094))),
    "katakana": "".join(map(chr, range(0x30AB, 0x30F4))),
    "hangul": "".join(chr(0xAC00 + 28 * i) for i in range(0, 399, 3)),
    "han": "".join(map(chr, range(0x4E00, 0x4E80))),
}
DRAWS = 64


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def chars(text: Column) -> Column:
    return F.split(text, "(?!^)(?!$)")


def by_script(text: Column, values: dict[str, Column], other: Column) -> Column:
    """The value for the script of a text (that of any letter beyond ASCII, else latin)."""
    out = values["latin"]
    for name in ALPHABET:
        if name != "latin":
            out = F.when(text.rlike(rf"\p{{Is{name.capitalize()}}}"), values.get(name, other)).otherwise(out)
    return out


def luhn(digits: Column) -> Column:
    """Sum of the card checksum; the last digit is the check digit."""
    d = F.transform(chars(F.reverse(digits)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x)


def iban_check(country: Column, body: Column) -> Column:
    """The two check digits of an account number."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(chars(F.concat(body, country, F.lit("00"))), F.lit(0), lambda a, c: (F.when(c.rlike("^[0-9]$"), a * 10).otherwise(a * 100) + value(c)) % 97)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def kind(mention: Column) -> Column:
    """The kind of a mention; null if it is none after all."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    octets = F.forall(F.split(mention, r"\."), lambda o: F.coalesce(o.try_cast("int"), F.lit(999)) <= 255)
    # long runs of digits are cards that fail the checksum
    out = F.when(mention.rlike(rf"^(?:{SECRET}{{6,}}|{SIGNED})$") & ~(mention.rlike(r"^[0-9][0-9\-]*$") & (F.length(digits) >= 13)), "secret")
    found = {
        "ip6": mention.rlike("^" + PATTERNS["ip6"] + "$"),
        "person": mention.rlike(rf"^(?:{TITLE})\.? \p{{Lu}}"),
        "phone": mention.rlike("^" + PATTERNS["phone"] + "$"),
        "ssn": mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "card": mention.rlike(r"^[0-9][0-9 \-]+$") & F.length(digits).between(13, 19) & (luhn(digits) % 10 == 0),
        "iban": mention.rlike("^" + PATTERNS["iban"] + "$"),
        "ip": mention.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & octets,
        "email": mention.rlike(r"@[^@]*\."),
    }
    for k, test in found.items():
        out = F.when(test, k).otherwise(out)
    return out


def units(mention: Column) -> Column:
    """Parts of a mention: kind (null: kept as it is) and raw text, which joined give the mention."""
    return bind(kind(mention), lambda k: _units(mention, k))


def _units(mention: Column, k: Column) -> Column:
    part = lambda kind, raw: F.struct(kind.cast("string").alias("kind"), raw.alias("raw"))
    kept = lambda raw: part(F.lit(None), raw)
    local, domain = F.substring_index(mention, "@", 1), F.substring_index(mention, "@", -1)
    name, tld = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.regexp_extract(domain, r"(\.[^.]+)$", 1)
    email = F.array(part(F.lit("local"), local), kept(F.lit("@")), part(F.lit("domain"), name), kept(tld))
    title = F.regexp_extract(mention, rf"^((?:{TITLE})\.? )", 1)
    bare = F.regexp_replace(title, r"\.? $", "")
    gender = F.when(bare.isin(TITLES["m"]), "m").when(bare.isin(TITLES["f"]), "f").otherwise("u")
    names = F.split(F.substring(mention, F.length(title) + 1, F.length(mention)), " ")
    last = F.size(names) - 1
    said = F.flatten(F.transform(names, lambda n, i: F.array(kept(F.when(i > 0, " ").otherwise("")), part(F.when(i < last, F.concat(F.lit("given_"), gender)).otherwise("family"), n))))
    person = F.concat(F.array(kept(title)), said)
    return F.when(k == "email", email).when(k == "person", person).otherwise(F.array(part(k, mention)))


def normal(kind: Column, raw: Column) -> Column:
    """What mentions of the same unit have in common."""
    numbers = F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(raw, "[^0-9]", ""))
    return F.coalesce(numbers, F.when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))), F.when(kind.isin("ip", "secret"), raw), F.lower(raw))


def _stream(key: str, kind: Column, norm: Column, draw: Column) -> Column:
    """Hex digits, four for each character of the unit, and sixteen more."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, draw.cast("string"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / 12).cast("int")), lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 256)), "")


def _number(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (4 * i + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _pick(stream: Column, i: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), _number(stream, i) % len(alphabet) + 1, F.lit(1))


def _letters(stream: Column, norm: Column) -> Column:
    """Digit for digit and letter for letter, in the script of the unit; other characters stay."""

    def each(alphabet: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            other = F.substring(alphabet, _number(stream, i) % F.length(alphabet) + 1, F.lit(1))
            return F.when(c.rlike("^[0-9]$"), (_number(stream, i) % 10).cast("string")).when(c.rlike("^[a-z]$"), _pick(stream, i, ALPHABET["latin"])).when(c.rlike(rf"^[{LETTER}]$"), other).otherwise(c)

        return F.array_join(F.transform(chars(norm), one), "")

    return bind(by_script(norm, {k: F.lit(a) for k, a in ALPHABET.items()}, F.lit(ALPHABET["latin"])), each)


def _digits(stream: Column, norm: Column, keep: Column) -> Column:
    """New digits beyond the first ``keep``; no leading zero in what follows."""
    return F.array_join(F.transform(chars(norm), lambda c, i: F.when(i < keep, c).when(i == keep, (2 + _number(stream, i) % 8).cast("string")).otherwise((_number(stream, i) % 10).cast("string"))), "")


#: Vowels and consonants for syllables (fixed values).
SYLLABLES = {"latin": ("aeiou", "bdklmnrstv"), "cyrillic": ("аеиоу", "бвдклмнрст"), "greek": ("αειου", "βδκλμνρστ")}


def _name(stream: Column, norm: Column, draw: Column, lists: dict[str, str]) -> Column:
    """A name of the list in the script; drawn again, with a syllable or more added. Other scripts: letters."""
    chosen = by_script(norm, {k: F.array(*[F.lit(w) for w in (*SYLLABLES[k], *words.lower().split())]) for k, words in lists.items()}, F.array().cast("array<string>"))

    def one(words: Column) -> Column:
        pick = lambda part, i: F.substring(words[part], _number(stream, i) % F.length(words[part]) + 1, F.lit(1))
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), draw)), lambda k: F.concat(pick(1, 2 + 2 * (k % 6)), pick(0, 3 + 2 * (k % 6)))), "")
        i = (F.conv(F.substring(stream, 1, 8), 16, 10).cast("long") % (F.size(words) - 2)).cast("int")
        return F.when(F.size(words) > 2, F.concat(words[i + 2], F.when(draw > 0, more).otherwise(""))).otherwise(_letters(stream, norm))

    return bind(chosen, one)


def surrogate(key: str, kind: Column, norm: Column, draw: Column) -> Column:
    """The normal form that stands for a unit, at its ``draw``-th draw."""
    # the stream is computed once for a unit, as it is bound to a variable
    return bind(_stream(key, kind, norm, draw), lambda st: _drawn(st, kind, norm, draw))


def _drawn(st: Column, kind: Column, norm: Column, draw: Column) -> Column:
    card = bind(F.substring(_digits(st, norm, F.lit(1)), F.lit(1), F.length(norm) - 1), lambda body: F.concat(body, ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")))
    octet = lambda o, i: F.when((F.length(o) == 3) | (draw > 8), 100 + _number(st, i) % 156).when(F.length(o) == 2, 10 + _number(st, i) % 90).otherwise(1 + _number(st, i) % 9).cast("string")
    ip = F.array_join(F.transform(F.split(norm, r"\."), octet), ".")
    phone = _digits(st, norm, F.greatest(F.lit(0), F.length(norm) - 10))
    hexed = F.array_join(F.transform(chars(norm), lambda c, i: _pick(st, i, "0123456789abcdef")), "")
    # a character stays in its class, but for access keys, whose alphabet has both
    access = norm.startswith("AKIA") & (F.length(norm) == 20)
    mixed = lambda c, i: F.when(access & (i < 4), c).when(access, _pick(st, i, string.ascii_uppercase + "234567")).when(c.rlike("^[0-9]$"), _pick(st, i, string.digits)).when(c.rlike("^[A-Z]$"), _pick(st, i, string.ascii_uppercase)).when(c.rlike("^[a-z]$"), _pick(st, i, ALPHABET["latin"])).otherwise(c)
    upper = F.array_join(F.transform(chars(norm), mixed), "")
    # a short secret or name of an address has few of its like: each draw after the fourth makes it a letter longer
    longer = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), draw - 5)), lambda k: F.when(draw > 4, _pick(st, k % 12, ALPHABET["latin"])).otherwise("")), "")
    secret = F.concat(F.when(norm.rlike("^[0-9]+$"), _digits(st, norm, F.lit(0))).when(norm.rlike("^[0-9a-f]+$"), hexed).otherwise(upper), longer)
    # groups keep their lengths, or have four digits after the eighth draw
    ip6 = F.array_join(F.transform(F.split(norm, ":"), lambda g, i: F.substring(st, 4 * i + 1, F.when((draw > 8) & (g != ""), 4).otherwise(F.length(g)))), ":")
    iban = bind(F.array_join(F.transform(chars(F.substring(norm, 5, 40)), lambda c, i: F.when(c.rlike("^[0-9]$"), (_number(st, i) % 10).cast("string")).otherwise(_pick(st, i, string.ascii_uppercase))), ""), lambda body: F.concat(F.substring(norm, 1, 2), iban_check(F.substring(norm, 1, 2), body), body))
    out = F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "phone", phone).when(kind == "ssn", _digits(st, norm, F.lit(0))).when(kind == "secret", secret).when(kind == "iban", iban)
    for g in ("m", "f", "u"):
        out = out.when(kind == f"given_{g}", _name(st, norm, draw, GIVEN[g]))
    out = out.when(kind == "family", _name(st, norm, draw, FAMILY))
    return out.otherwise(F.concat(_letters(st, norm), longer))


def dressed(kind: Column, raw: Column, new: Column) -> Column:
    """A surrogate in the form of the mention: its separators, or its letter case."""
    return bind(new, lambda n: _dressed(kind, raw, n))


def _dressed(kind: Column, raw: Column, new: Column) -> Column:

    def put(acc: Column, c: Column) -> Column:
        mark = ~c.rlike("^[A-Za-z0-9]$")
        return F.struct((acc["i"] + F.when(mark, 0).otherwise(1)).alias("i"), F.concat(acc["s"], F.when(mark, c).otherwise(F.substring(new, acc["i"], F.lit(1)))).alias("s"))

    apart = F.aggregate(chars(raw), F.struct(F.lit(1).alias("i"), F.lit("").alias("s")), put, lambda a: a["s"])
    each = F.array_join(F.zip_with(chars(raw), chars(new), lambda r, n: F.when(r.rlike(r"^\p{Lu}$"), F.upper(n)).otherwise(n)), "")
    case = F.when(F.length(raw) == F.length(new), each).when((F.upper(raw) == raw) & (F.lower(raw) != raw) & (F.length(raw) > 1), F.upper(new)).when(raw.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), apart).when(kind.isin("ip", "secret"), new).otherwise(case)


def mentions(text: Column) -> Column:
    """The mentions of a text, in order; one pattern search only where a hint of one is."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def found_mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Key and mentions (m) of the text of each row, written: what asks for them before the texts are changed searches no text again."""
    text = col(text_col).cast("string")
    # no filter here, as one would be pushed below and search each text a second time
    return written(docs.select(*text_key(text), mentions(text).alias("m")), "mentions").where(F.size("m") > 0)


def drawn_again(docs: DataFrame, key: str, text_col: str = "text", found: DataFrame | None = None) -> DataFrame | None:
    """Units (kind, norm) whose first draw collides, and the draw that does not; None if there are none. ``found``: what ``found_mentions`` gave."""
    found = found_mentions(docs, text_col) if found is None else found
    found = found.select(F.explode("m").alias("m")).groupBy("m").agg(F.lit(1)).select(F.explode(units(F.col("m"))).alias("u"))
    found = found.where("u.kind is not null").select("u.kind", normal(F.col("u.kind"), F.col("u.raw")).alias("norm"))
    # gender has no part in telling names apart
    space = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind")).alias("space")
    every = written(found.distinct().select("kind", "norm", space), "units")
    # a person's given name may occur under several titles
    real = every.select("space", "norm").distinct()
    taken, open_ = None, every.withColumn("draw", F.lit(0))
    again = None
    for draw in range(DRAWS):
        new = open_.withColumn("new", surrogate(key, F.col("kind"), F.col("norm"), F.lit(draw)))
        first = F.row_number().over(Window.partitionBy("space", "new").orderBy("norm", "kind")) == 1
        good = new.withColumn("ok", first).where("ok").join(real.withColumnRenamed("norm", "new"), ["space", "new"], "left_anti")
        if taken is not None:
            good = good.join(taken, ["space", "new"], "left_anti")
        good = written(good.select("kind", "norm", "space", "new", F.lit(draw).alias("draw")), "drawn")
        left = written(open_.drop("draw").join(good.select("kind", "norm"), ["kind", "norm"], "left_anti"), "undrawn")
        taken = good.select("space", "new") if taken is None else taken.union(good.select("space", "new"))
        if draw:
            again = good if again is None else again.union(good)
        if left.isEmpty():
            return None if again is None else written(again.select("kind", "norm", "draw"), "redrawn")
        open_ = left.withColumn("draw", F.lit(draw + 1))
    raise ValueError(f"{left.count()} units have no free surrogate after {DRAWS} draws")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and n_replaced and entities (kind and surrogate of each, in order).

    Null texts stay null and have no entities; texts without any stay as
    they are to the character. The same key gives the same surrogates
    for the same corpus. Columns of the new names give way; repeated rows stay.
    """
    found = found_mentions(docs, text_col)
    again = drawn_again(docs, key, text_col, found)
    names = [c for c in docs.columns if c not in ("n_replaced", "entities")]
    rows = docs.select(row_of([c for c in names if c != text_col]), col(text_col).cast("string").alias("text")).withColumn("m", mentions(F.col("text")))
    if again is not None:
        # by text: what of it was drawn again
        met = found.select("_k1", "_k2", F.explode("m").alias("m")).distinct().select("_k1", "_k2", F.explode(units(F.col("m"))).alias("u")).where("u.kind is not null")
        met = met.select("_k1", "_k2", "u.kind", normal(F.col("u.kind"), F.col("u.raw")).alias("norm")).distinct().join(again, ["kind", "norm"])
        met = met.groupBy("_k1", "_k2").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "norm"), "draw"))).alias("again"))
        rows = rows.select("*", *text_key(F.col("text"))).join(written(met, "redrawn-texts"), ["_k1", "_k2"], "left")

    def new(u: Column) -> Column:
        def drawn(norm: Column) -> Column:
            draw = F.lit(0) if again is None else F.coalesce(F.try_element_at(F.col("again"), F.concat_ws("\x1f", u["kind"], norm)), F.lit(0))
            return dressed(u["kind"], u["raw"], bind(draw, lambda d: surrogate(key, u["kind"], norm, d)))

        return F.when(u["kind"].isNull(), u["raw"]).otherwise(bind(normal(u["kind"], u["raw"]), drawn))

    def one(m: Column) -> Column:
        return F.struct(kind(m).alias("kind"), F.array_join(F.transform(units(m), new), "").alias("surrogate"))

    rows = rows.withColumn("all", F.transform("m", one))
    put = F.array_join(F.zip_with(F.split("text", ENTITY, -1), F.col("all"), lambda b, e: F.concat(b, F.coalesce(e["surrogate"], F.lit("")))), "")
    changed = F.when(F.size("m") > 0, put).otherwise(F.col("text"))
    told = F.coalesce(F.filter("all", lambda e: e["kind"].isNotNull()), F.array().cast("array<struct<kind: string, surrogate: string>>"))
    rows = rows.select("row", changed.alias("text"), told.alias("entities"))
    own = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]
    return rows.select(*own, F.size("entities").cast("long").alias("n_replaced"), "entities")
