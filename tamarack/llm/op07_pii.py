"""PII surrogates: each detected entity gets a keyed replacement of its own type and format, the same everywhere.

DataFrame functions only. One regular expression with a group for each type marks the entities of a text; plain searches tell which types a text can
have, so the usual text meets a small part of it. Each text is marked once; the marked texts are a table in the shared folder. Mentions are rows: the distinct
entities of the corpus form a dictionary, in which each round gives the entities without a surrogate a keyed candidate, accepted
if no other entity of the type has it and no entity of the corpus is written so; the rest go to the next round, with another
key stream and a larger space. So distinct entities have distinct surrogates and mentions of one entity keep one. The dictionary is joined back
to the mentions by a shuffle, gathered for each document in order, and written into the text.

Formats: digits of phone, card, social-security and account numbers are permuted by a keyed Feistel network over their digits and laid
out in the mention's own punctuation (cards keep their first digit and the outcome of the Luhn test, phones their country code and first digit,
accounts their country and valid check digits); addresses of the internet protocol stay addresses; mail keeps the shape of its
local part and gets a domain under example; keys keep prefix, length and alphabet. Names after a title get names of the
title's gender and of the name's script (Latin, Cyrillic and Greek; names of other scripts are left alone); first and last names have surrogates of their own, so "Mr John Smith" and
"Mr Smith" stay one person; so do "John Smith", "Smith" and "John" without a title in a text that has them after one: each capitalised word of such a text is looked
up among the text's own names (a word that is both is taken as a last name). Names that never have a title are not found.

No pattern makes Java's matcher recurse with the length of a text or start over within a run of characters: repeated groups are possessive, and runs begin only where
the character before them is none of theirs. So texts of any length and shape are read whole, in time linear in their length.

The key has no default: whoever knows it can undo the permutations (it is part of the query's plan, so event logs that hold plans are as secret as the key).

Defined results: null text stays null; texts without entities are unchanged, character for character; repeated rows each appear; equal texts give equal texts;
an empty table gives an empty result. Other columns pass through untouched, whatever their names; n_chars, where there is one, follows the text; the count of
entities takes the place of a column of its name, and `count_column=None` leaves it out. If a number's form is so full that the rounds end with entities left, all numbers of that type take
one permutation, which keeps them distinct but may give a number that the corpus has elsewhere.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.common import checkpointed, stored

ROUNDS = 12
#: Where a session's key is configured.
KEY_SETTING = "spark.tamarack.pii.key"
_DRAWN: dict[str, str] = {}
#: Noncharacters mark an entity's beginning, its groups and its end; a fourth escapes them where a text has them.
OPEN, NEXT, CLOSE, ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
#: What follows the escape; no digits or letters, so that an entity beside it is found as in the text itself.
ESCAPES = [(ESCAPE, "\ufdd7"), (OPEN, "\ufdd4"), (NEXT, "\ufdd5"), (CLOSE, "\ufdd6")]

_MALE, _FEMALE, _ANY = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"], ["Mrs", "Ms", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Госпожа", "Κυρία"], ["Dr", "Prof"]
_KEY_WORDS = ["token", "secret", "passw", "pwd", "key", "auth", "bearer"]
_KEY_SHAPES = ["akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "sk_", "xox", "eyj", "aiza"]
#: Letters of the scripts that have surrogate names.
_LETTER = r"[\p{L}\p{M}&&[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsInherited}]]"
#: Name words: hyphens, apostrophes (but no possessive s) and inner capitals; initials and particles may stand before one.
_NAME = rf"[\p{{Lu}}&&[\p{{IsLatin}}\p{{IsCyrillic}}\p{{IsGreek}}]](?:{_LETTER}|['’](?={_LETTER}{{2}})|-(?={_LETTER}))++"
_BEFORE = r"(?:(?:\p{Lu}\.|von|van|der|den|de|del|della|la|le|di|da|dos|du|ter|zu|zur|al|bin)\x20)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_NO_WORD = r"(?![\p{L}\p{N}])"
#: Characters of a secret's value; a dot only within it, and a sign of equality only where no key word stands before it, so that values of several keys don't overlap.
_VALUE = r"(?:[A-Za-z_\-/+]|\.(?=[A-Za-z0-9_\-/+=])|(?<!(?i:token|secret|password|passwd|pwd|key|bearer))=)"
_VALUE_OR_DIGIT = _VALUE.replace("A-Za-z_", "A-Za-z0-9_", 1)


def _titled(titles: list[str]) -> tuple[str, str]:
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(titles, key=len, reverse=True))})\.?\x20", rf"{_BEFORE}*+{_NAME}(?:\x20{_BEFORE}*+{_NAME})*+{_NO_WORD}"


#: (what a text must have, type, gate, prefix that stays, entity); at one place the first that fits holds. The gates let most places fail at their first character.
PATTERNS = [
    ("at", "email", "", "", r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?=[\p{L}\p{N}])[\p{L}\p{N}.\-]*\.\p{L}{2,}+"),
    (
        "key", "secret", "(?=[tspabkTSPABK])",
        r"(?i:token|secret|passw(?:or)?d|pwd|api[_\-]?key|access[_\-]?key|auth[_\-]?key|private[_\-]?key|key|bearer)[\"']?(?:\s{0,3}[:=]\s{0,3}|(?<=(?i:bearer))\x20)[\"']?",
        rf"(?={_VALUE}*+[0-9])(?!\.){_VALUE_OR_DIGIT}{{8,}}+",
    ),
    ("key", "secret", "(?=[AgsxeI])", "", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_\-]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,}|(?<![_\-])eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}|AIza[A-Za-z0-9_\-]{30,})"),
    (
        "digit", "ipv6", "(?=[0-9A-Fa-f]{0,4}:)", "",
        rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*+[0-9])(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\p{{L}}\p{{N}}:])",
    ),
    ("digit", "iban", r"(?=[A-Z]{2}\d{2})", "", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("digit", "card", r"(?=\d)", "", r"(?<![\d.])(?:\d{16}|\d{4}\x20\d{4}\x20\d{4}\x20\d{4}(?:\x20\d{3})?|\d{4}-\d{4}-\d{4}-\d{4}(?:-\d{3})?|3\d{14}|3\d{3}[\x20\-]\d{6}[\x20\-]\d{5}|3[0689]\d{12}|3[0689]\d{2}[\x20\-]\d{6}[\x20\-]\d{4}|4\d{12}(?:\d{6})?|62\d{15,17})(?!\d)"),
    ("digit", "ssn", r"(?=\d{3}-)", "", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("digit", "ssn", "(?=[Ss][Ssoi])", r"(?<![\p{L}\p{N}])(?i:ssn|sin|social[ -]security(?:\x20(?:number|no\.?))?)(?:\x20is)?[\x20:#]{1,3}", r"\d{3}\x20?\d{2}\x20?\d{4}(?!\d)"),
    ("digit", "ipv4", r"(?=\d{1,3}\.)", "", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    ("digit", "phone", r"(?=[\d+(])", "", r"(?:(?<!\d)\+\d{1,3}(?:[\x20.\-]?\(?\d{1,4}\)?){2,6}+(?!\d)|(?<![\d.\-])(?:(?:1[\x20.\-])?(?:\(\d{3}\)\x20?|\d{3}[\x20.\-])\d{3}[\x20.\-]\d{4}|0\d(?:(?:\x20\d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})|0\d{2,4}[\x20/\-]\d{5,}|\(0\d{1,4}\)\x20?\d{5,}|0\d{2,4}\x20\d{3,4}\x20\d{3,4}|0\d{9,10}|[2-9]\d{9})(?![\d\-]))"),
    ("digit", "secret", "(?=[0-9a-f]{32})", "", r"(?<![A-Za-z0-9])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"),
    ("title", "name_m", "(?=[MHSГΚ])", *_titled(_MALE)),
    ("title", "name_f", "(?=[MFSГΚ])", *_titled(_FEMALE)),
    ("title", "name_x", "(?=[DP])", *_titled(_ANY)),
    # any capitalised word: a mention only if the text has it after a title
    ("title", "word", r"(?=\p{Lu})", "", rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){_NAME}(?![\p{{L}}\p{{M}}\p{{N}}])"),
]
#: Never matches; a pattern that holds a character of two code units looks behind and starts at whole characters.
_WHOLE = "|(?!)\U00010000"
FOUND = [kind for _, kind, *_ in PATTERNS]
_MARKED = "".join(f"${2 * i + 1}" for i in range(len(FOUND))) + OPEN + NEXT.join(f"${2 * i + 2}" for i in range(len(FOUND))) + CLOSE
#: A marked name after a title, and marked words.
_HAS_NAME = f"{OPEN}{NEXT}{{{FOUND.index('name_m')},{FOUND.index('name_x')}}}[^{NEXT}{CLOSE}]"
_WORD = f"{OPEN}{NEXT}{{{FOUND.index('word')}}}([^{NEXT}{CLOSE}]+){CLOSE}"


def _contains_any(text: Column, parts: list[str]) -> Column:
    shortest = [p for p in parts if not any(p != q and q in p for q in parts)]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in shortest])


def _by_need(text: Column, leaf: Callable[[str], Column], nothing: Column) -> Column:
    """leaf(pattern) with the pattern of what a text can have. Plain searches tell which entities that is; the usual text needs no pattern."""
    has = {"at": F.contains(text, F.lit("@")), "digit": text.rlike("[0-9]"), "key": _contains_any(F.lower(text), _KEY_WORDS + _KEY_SHAPES), "title": _contains_any(text, _MALE + _FEMALE + _ANY)}

    def branch(left: list[str], needed: set[str]) -> Column:
        if left:
            return F.when(has[left[0]], branch(left[1:], needed | {left[0]})).otherwise(branch(left[1:], needed))
        # a pattern that isn't needed leaves two empty groups, so that numbers stay
        return leaf("|".join(f"{gate}({prefix})({entity})" if flag in needed else "(?!)()()" for flag, _, gate, prefix, entity in PATTERNS) + _WHOLE) if needed else nothing

    return branch(list(has), set())


#: Surrogate names, by script and gender.
NAMES = {
    ("latin", "first_m"): "Adam Alan Albert Anton Bruno Carl Carlos Daniel David Diego Edgar Emil Erik Felix Frank Georg Hugo Ivan Jan Jonas Jules Karl Kevin Leon Louis Lucas Marc Martin Max Nico Oscar Paul Pedro Peter Ralph Robert Simon Theo Victor Walter".split(),
    ("latin", "first_f"): "Ada Alice Amelia Anna Bella Carla Carmen Celine Clara Diana Elena Elsa Emma Erika Eva Fiona Greta Hanna Helena Ines Irene Jana Julia Karin Laura Lena Lucia Marie Marta Mia Nadia Nina Olga Paula Petra Rosa Sara Sofia Vera Zoe".split(),
    ("latin", "first_x"): "Alex Andrea Ariel Avery Blake Cameron Casey Chris Dana Dominique Drew Elia Finn Florence Gabriel Jamie Jess Jordan Jules Kai Kim Lee Lou Luca Marion Maxime Morgan Nikita Noa Pat Quinn Robin Ruby Sacha Sam Sandy Sasha Sidney Toni Val".split(),
    ("latin", "last"): "Abbott Adler Arnold Bailey Barnes Becker Benson Blanc Bonnet Brandt Carter Castro Chevalier Collins Conrad Cooper Delgado Dubois Duran Ellis Faber Fischer Fontaine Foster Franke Garner Gauthier Graf Haas Harper Herrera Hoffman Ibarra Jansen Keller Klein Lambert Lang Leclerc Lopez Lowe Marin Mercier Meyer Molina Morel Navarro Neumann Olsen Ortega Palmer Perrin Pons Quinn Ramos Renard Richter Rivas Roth Roussel Sanders Schmid Serrano Sommer Stone Thiel Torres Turner Vidal Vogel Wagner Walker Weber Winter Wolf York Zeller Ziegler Zimmer Zola".split(),
    ("cyrillic", "first_m"): "Алексей Андрей Борис Виктор Глеб Денис Иван Игорь Кирилл Максим Никита Олег Павел Роман Сергей Юрий".split(),
    ("cyrillic", "first_f"): "Алла Анна Вера Галина Дарья Елена Жанна Инна Ксения Лариса Мария Нина Ольга Раиса Софья Юлия".split(),
    ("cyrillic", "first_x"): "Саша Женя Валя Слава Шура Паша Витя Тоня".split(),
    ("greek", "first_m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Μανώλης Νίκος Πέτρος Σπύρος Στέλιος Χρήστος".split(),
    ("greek", "first_f"): "Άννα Βασιλική Ειρήνη Ελένη Ζωή Κατερίνα Μαρία Σοφία Φωτεινή Χριστίνα".split(),
    ("greek", "first_x"): "Αλέξης Άρης Σάσα Φοίβη Χάρις".split(),
    ("greek", "last"): "Αλεξίου Γεωργίου Δήμου Ζήκος Ιωάννου Κωνσταντίνου Λάμπρου Μάρκου Νικολάου Οικονόμου Πέτρου Σταύρου".split(),
    ("cyrillic", "last"): "Белов Волков Гусев Егоров Зайцев Иванов Козлов Лебедев Морозов Новиков Орлов Павлов Смирнов Тарасов Фролов Яковлев".split(),
}


def _hash(*parts: Column | str | int) -> Column:
    """A keyed number of 60 bits."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(rows: DataFrame, digits: Column, key: str, salt: Column, attempt: int) -> DataFrame:
    """rows with `moved`: a keyed permutation of the digit strings of one length (up to 34) and salt. Each half is shifted by a hash of the other, four times.

    Each turn is a column of its own, so that the expression doesn't grow with the turns."""
    cut = F.floor(F.length(digits) / 2).cast("int")
    rows = rows.withColumns({"left": F.substring(digits, F.lit(1), cut), "right": F.substring(digits, cut + 1, F.length(digits)), "salt": salt})
    for turn in range(4):
        own, other = ("right", "left") if turn % 2 == 0 else ("left", "right")
        size = F.length(own)
        shift = F.pmod(_hash(key, attempt, turn, F.col("salt"), size + F.length(other), F.col(other)), _power(size))
        moved = F.lpad(F.pmod(F.col(own).cast("long") + shift, _power(size)).cast("string"), size, "0")
        rows = rows.withColumn(own, F.when(size == 0, F.lit("")).otherwise(moved))
    return rows.withColumn("moved", F.concat("left", "right")).drop("left", "right", "salt")


def _reshape(text: Column, hexadecimal: Column, key: str, salt: Column, attempt: int, digest: Column) -> Column:
    """Each letter and digit replaced by a keyed one of its class; lower hexadecimal strings stay so. digest stands for the whole entity. All but text are plain columns, for they are read at each letter."""

    def pick(alphabet: str, h: Column) -> Column:
        return F.substring(F.lit(alphabet), F.pmod(h, F.lit(len(alphabet))) + 1, F.lit(1))

    def replace(c: Column, i: Column) -> Column:
        h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(f"{key}|{attempt}"), salt, i.cast("string"), digest), 256), 1, 4), 16, 10).cast("int")
        return (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), pick("0123456789abcdef", h))
            .when(c.rlike("[0-9]"), pick("0123456789", h))
            .when(c.rlike(r"\p{Lu}"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", h))
            .when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz", h))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), replace), "")


def luhn(body: Column) -> Column:
    """The check digit of a digit string."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return F.pmod(10 - total % 10, F.lit(10))


def _mod97(text: Column) -> Column:
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def canonical(kind: Column, raw: Column) -> Column:
    """What mentions of one entity have in common."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(raw.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind.isin("email", "ipv6"), F.lower(raw))
        .otherwise(raw)
    )


def candidates(rows: DataFrame, key: str, attempt: int) -> DataFrame:
    """kind, canon and the surrogate that a round proposes, for rows of kind, canon and digest (the entity's hash)."""
    kind, canon, digest, digits = (F.col(c) for c in ("kind", "canon", "digest", "digits"))
    n = F.length(digits)
    rows = rows.withColumn("digits", F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(canon, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(F.substring(canon, F.lit(5), F.length(canon)), "[^0-9]", "")).otherwise(F.lit("")))
    # what stays of a number, before the digits that are permuted
    rows = rows.withColumn("kept", F.when(kind == "phone", F.substring(digits, F.lit(1), F.greatest(n - 9, F.lit(1)))).when(kind == "card", F.substring(digits, 1, 1)).otherwise(F.lit("")))
    inner = F.substring(digits, F.length("kept") + 1, n - F.length("kept") - F.when(kind == "card", 1).otherwise(0))
    rows = permute_digits(rows, inner, key, F.concat_ws("|", kind, "kept", F.when(kind == "iban", F.regexp_replace(F.concat(F.substring(canon, 1, 2), F.substring(canon, F.lit(5), F.length(canon))), "[0-9]", "#"))), attempt)
    rows = rows.withColumn("moved", F.concat("kept", "moved"))
    moved = F.col("moved")

    # addresses of four parts: two halves of 16 bits
    octets = F.split(canon, r"\.")
    half = lambda i: F.when(kind == "ipv4", F.get(octets, F.lit(i)).cast("long") * 256 + F.get(octets, F.lit(i + 1)).cast("long"))
    rows = rows.withColumns({"high": half(0), "low": half(2)})
    for turn in range(2):
        for own, other in (("low", "high"), ("high", "low")):
            rows = rows.withColumn(own, (F.col(own) + F.pmod(_hash(key, attempt, turn, own, F.col(other)), F.lit(65536))) % 65536)

    # letters and digits of mail, keys and long addresses
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    prefix = F.when(kind == "secret", F.regexp_extract(canon, "^(AKIA|gh[pousr]_|sk[-_]|xox[abprs]-|eyJ|AIza)", 1)).otherwise(F.lit(""))
    rows = rows.withColumn("prefix", prefix)
    rows = rows.withColumn("body", F.when(kind == "email", local).when(kind == "ipv6", canon).when(kind == "secret", F.substring(canon, F.length("prefix") + 1, F.length(canon))))
    rows = _once(rows, "hexadecimal", F.col("body").rlike("^[0-9a-f:]++$"))
    rows = rows.withColumn("shaped", F.when(F.col("body").isNotNull(), _reshape(F.col("body"), F.col("hexadecimal"), key, kind, attempt, digest)))

    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    rows = rows.withColumn("script", F.when(kind.startswith("first") | (kind == "last"), script))
    names = reduce(lambda c, x: c.when((F.col("script") == x[0][0]) & (kind == x[0][1]), F.array(*map(F.lit, x[1]))), NAMES.items(), F.when(F.col("script").isNull(), F.lit(None).cast("array<string>")))
    rows = rows.withColumn("names", names)

    card = F.concat(moved, F.pmod(luhn(moved) + F.substring(digits, -1, 1).cast("int") - luhn(F.substring(digits, F.lit(1), n - 1)), F.lit(10)).cast("string"))
    country, account = F.substring(canon, 1, 2), F.substring(canon, F.lit(5), F.length(canon))
    rows = rows.withColumn("laid", F.when(kind == "iban", _lay_out(account, moved)))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat("laid", country, F.lit("00")))).cast("string"), 2, "0"), "laid")
    more = F.substring(F.sha2(F.concat_ws("|", F.lit(f"{key}|{attempt}"), canon), 256), F.lit(1), F.lit(4 * attempt))
    ending = F.substring_index(domain, ".", -1)
    email = F.concat("shaped", more, F.lit("@m"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), domain), 256), 1, 12), F.lit(".example"), F.when(ending.isin("com", "net", "org"), F.concat(F.lit("."), ending)).otherwise(""))
    # a short address has few of its form: later rounds add a group
    group = F.concat(F.lit("::"), F.substring(F.sha2(F.concat_ws("|", F.lit(f"{key}|ipv6 {attempt}"), canon), 256), 1, 4), F.when(canon.endswith("::"), F.lit("")).otherwise(F.lit(":")))
    ipv6 = F.replace("shaped", F.lit("::"), group) if attempt else F.col("shaped")
    # each round adds a part, so the space outgrows any number of names; feminine family names end so
    one = lambda p: F.get("names", F.pmod(_hash(key, kind, p, attempt, canon), F.size("names")).cast("int"))
    name = F.concat(F.concat_ws("-", *[one(p) for p in range(attempt + 1)]), F.when((F.col("script") == "cyrillic") & (kind == "last") & canon.rlike("[ая]$"), "а").otherwise(""))

    out = F.when(kind == "phone", F.concat(F.when(canon.startswith("+"), "+").otherwise(""), moved)).when(kind == "ssn", moved).when(kind == "card", card).when(kind == "iban", iban).when(kind == "email", email).when(kind == "ipv6", ipv6)
    out = out.when(kind == "ipv4", F.concat_ws(".", *[x.cast("string") for h in ("high", "low") for x in (F.floor(F.col(h) / 256), F.col(h) % 256)]))
    return rows.select("kind", "canon", out.when(kind == "secret", F.concat("prefix", "shaped")).otherwise(name).alias("surrogate"))


def _lay_out(raw: Column, digits: Column) -> Column:
    """The digits written over those of raw, one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(a: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(a["out"], F.when(is_digit, F.substring(digits, a["next"], F.lit(1))).otherwise(c)).alias("out"), (a["next"] + is_digit.cast("int")).alias("next"))

    return F.aggregate(F.split(raw, ""), start, step, lambda a: a["out"])


def written(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format."""
    digits = F.regexp_replace(surrogate, "[^0-9]", "")
    spaced = F.when(raw.contains(" "), F.rtrim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn"), _lay_out(raw, digits)).when(kind == "iban", spaced).otherwise(surrogate)


def dictionary(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """kind, canon, surrogate of the distinct (kind, canon) in entities."""
    spark = entities.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = checkpointed(entities.select("kind", "canon").distinct().withColumn("digest", F.sha2(F.concat_ws("|", "kind", "canon"), 256)))
    spread = lambda rows: rows.repartition(tasks, "kind", "canon")  # noqa: E731  # candidates cost far more than their bytes tell
    accepted = spark.createDataFrame([], "kind string, canon string, surrogate string")
    pending = every
    for attempt in range(rounds):
        first = candidates(spread(pending), key, attempt).groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        taken = every.select("kind", F.col("canon").alias("surrogate")).unionByName(accepted.select("kind", "surrogate"))
        good = checkpointed(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "canon", "surrogate"))
        accepted = accepted.unionByName(good)
        pending = checkpointed(pending.join(good, ["kind", "canon"], "left_anti"))
        if pending.isEmpty():
            return accepted
    full = pending.select("kind").distinct()
    return accepted.join(full, "kind", "left_anti").unionByName(candidates(spread(every.join(full, "kind", "left_semi")), key, rounds))


def session_key(spark: SparkSession) -> str:
    """The key that KEY_SETTING names; where it is absent, one drawn at random for this application, which nobody can know afterwards."""
    return spark.conf.get(KEY_SETTING, None) or _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _escaped(text: Column) -> Column:
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(ESCAPE + x[1])), ESCAPES, text)


def _restored(text: Column) -> Column:
    return reduce(lambda t, x: F.replace(t, F.lit(ESCAPE + x[1]), F.lit(x[0])), ESCAPES[::-1], text)


def mark(text: Column) -> Column:
    """The text, escaped, with its entities between marks; null where it can have none."""
    return _by_need(text, lambda pattern: F.regexp_replace(_escaped(text), pattern, _MARKED), F.lit(None).cast("string"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that what follows reads without computing it again."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _segments(marked: Column) -> Column:
    return F.slice(F.split(marked, OPEN), 2, 1 << 30)


def _inside(segment: Column) -> Column:
    return F.substring_index(segment, CLOSE, 1)


def _outside(segment: Column) -> Column:
    return F.substring(segment, F.locate(CLOSE, segment) + 1, F.length(segment))


def _tails(segment: Column) -> Column:
    """What follows each part of a segment: a blank within a name, the text up to the next mark after the last part."""
    is_name = segment.rlike(f"^{NEXT}{{{FOUND.index('name_m')},{FOUND.index('name_x')}}}[^{NEXT}{CLOSE}]")
    blanks = F.when(is_name, F.array_repeat(F.lit(" "), F.size(F.split(_inside(segment), " ")) - 1)).otherwise(F.array().cast("array<string>"))
    return F.concat(blanks, F.array(_outside(segment)))


def mentions(marked: DataFrame) -> DataFrame:
    """row, place, part, kind, raw, canon of every mention in the marked texts, in order; kind is null for words that are no names of their text."""
    rows = marked.select("row", F.posexplode(_segments(F.col("marked"))).alias("place", "segment")).select("row", "place", _inside(F.col("segment")).alias("inside"))
    groups = F.split("inside", NEXT)
    kind = F.element_at(F.array(*[F.lit(t) for t in FOUND]), F.array_position(F.transform(groups, lambda g: g != ""), F.lit(True)).cast("int"))
    rows = _once(rows, "e", F.struct(kind.alias("kind"), F.array_join(groups, "").alias("raw"))).select("row", "place", "e.kind", "e.raw")
    # first and last names apart, anything else one part
    words, part = F.split("raw", " "), lambda k, r: F.struct(k.alias("kind"), r.alias("raw"))
    names = F.concat(F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: part(F.replace("kind", F.lit("name"), F.lit("first")), w)), F.array(part(F.lit("last"), F.element_at(words, -1))))
    parts = F.when(F.col("kind").startswith("name"), names).otherwise(F.array(part(F.col("kind"), F.col("raw"))))
    rows = rows.select("row", "place", F.posexplode(parts).alias("part", "e")).select("row", "place", "part", "e.kind", "e.raw")
    named = F.when(F.col("kind").startswith("first") | (F.col("kind") == "last"), F.col("kind"))
    own = F.max(named).over(Window.partitionBy("row", "raw"))  # of one text only
    rows = rows.withColumn("own", own).withColumn("kind", F.when(F.col("kind") == "word", F.col("own")).otherwise(F.col("kind"))).drop("own")
    return rows.withColumn("canon", canonical(F.col("kind"), F.col("raw")))


def replace_pii(docs: DataFrame, key: str, count_column: str | None = "n_entities") -> DataFrame:
    """The rows of docs with surrogates in text, then the number of entities of each row as count_column."""
    if not key:
        raise ValueError("surrogates need a key")
    columns = docs.columns
    name = {c: f"c{i}" for i, c in enumerate(columns)}
    own = docs.toDF(*name.values())  # names of the caller's columns can't clash with ours
    text = F.col(name["text"])
    made = _once(own.withColumn("row", F.monotonically_increasing_id()), "first", mark(text))
    # capitalised words matter only beside names
    made = _once(made, "second", F.when(F.contains("first", F.lit(OPEN)), F.when(F.col("first").rlike(_HAS_NAME), F.col("first")).otherwise(F.regexp_replace("first", _WORD, "$1"))))
    has = F.coalesce(F.contains("second", F.lit(OPEN)), F.lit(False))
    made = made.withColumn("has", has.cast("int")).withColumn("marked", F.when(has, F.col("second"))).withColumn(name["text"], F.when(~has, text)).drop("first", "second")
    table = stored(made, "pii", "has")
    marked, plain = table.where("has = 1"), table.where("has = 0")

    found = mentions(marked)
    known = dictionary(found.where("kind is not null"), key)
    # one entity may be in a large part of all documents: adaptive execution splits that partition of the mentions
    joined = found.join(known, ["kind", "canon"], "left")
    new = F.coalesce(written(F.col("kind"), F.col("raw"), F.col("surrogate")), F.col("raw"))
    of_text = joined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "part", new.alias("new")))).alias("parts"), F.count_if((F.col("part") == 0) & F.col("surrogate").isNotNull()).alias("n"))

    segments = _segments(F.col("marked"))
    tails = F.flatten(F.transform(segments, _tails))
    pieces = F.zip_with(F.col("parts")["new"], tails, lambda new, tail: F.concat(new, tail))
    done = F.concat(F.substring_index("marked", OPEN, 1), F.array_join(pieces, ""))
    with_any = marked.join(of_text, "row").withColumn(name["text"], _restored(done))
    if "n_chars" in name:
        length = F.when(F.col("n") > 0, F.length(name["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(name["n_chars"]))
        with_any = with_any.withColumn(name["n_chars"], length)
    out = with_any.select(*name.values(), "n").unionByName(plain.select(*name.values(), F.lit(0).cast("long").alias("n")))
    kept = [F.col(name[c]).alias(c) for c in columns if c != count_column]
    return out.select(*kept, *([F.col("n").alias(count_column)] if count_column else []))
