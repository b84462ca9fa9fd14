"""Surrogates for personal data, in DataFrame operations only.

Mentions are found by one pattern. A mention stands for one entity, or in a name for one by word (given
names and surname); its canonical form makes different spellings one entity. An entity's surrogate comes
from a keyed hash of its canonical form, keeps its kind, character classes, gender and script, what
its format prescribes (country codes, check digits of cards and IBANs, an address's top-level domain),
and is the same wherever the entity occurs. A check over all entities sees to it that no two share a
surrogate and that no surrogate is an entity of the corpus; those that fail are hashed anew with the
number of the attempt. Entities of one format that are too many for it, so that a sixteenth of its
values would be taken, get surrogates longer by as many characters as it takes, whatever their order.
Mentions keep their own punctuation.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import given_names
from .common import join_skewed, restored, shielded, stored

FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Doña", "Госпожа", "Κυρία")
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Sr", "Señor", "Господин", "Κύριος")
OTHER_TITLES = ("Dr", "Prof", "Professor")
FEMALE = ("Mary", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Margaret", "Emily", "Charlotte", "Ursula", "Sabine", "Monika", "Claudia", "Françoise", "Nathalie", "Isabelle", "Camille", "María", "Carmen", "Lucía", "Dolores", "Анна", "Мария", "Елена", "Ольга", "Μαρία", "Ελένη", *given_names.FEMALE)
MALE = ("James", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Jürgen", "Wolfgang", "Stefan", "Dieter", "François", "Philippe", "Nicolas", "Olivier", "José", "Antonio", "Manuel", "Francisco", "Иван", "Сергей", "Дмитрий", "Алексей", "Γιώργος", "Νίκος", *given_names.MALE)
#: Words that may stand before a surname in small letters.
PARTICLES = ("van", "von", "vom", "zu", "zum", "zur", "der", "den", "dem", "ter", "ten", "de", "del", "della", "delle", "dei", "di", "da", "do", "dos", "das", "du", "des", "la", "las", "le", "los", "y", "af", "av", "bin", "ibn", "bint", "al", "el", "ben")
#: Surrogate names of the first attempt, and the syllables and endings of the later ones, by script.
GIVEN = {
    ("latin", "f"): ("Alice", "Helen", "Laura", "Nora", "Clara", "Julia", "Martha", "Irene", "Paula", "Vera", "Emma", "Ruth", "Diana", "Sylvia", "Louise", "Rosa"),
    ("latin", "m"): ("Peter", "George", "Henry", "Oscar", "Victor", "Arthur", "Felix", "Hugo", "Martin", "Edgar", "Simon", "Leon", "Conrad", "Walter", "Julian", "Bruno"),
    ("latin", "n"): ("Robin", "Alex", "Kim", "Sasha", "Noel", "Morgan", "Taylor", "Jamie", "Quinn", "Rowan", "Jules", "Dana", "Ariel", "Casey", "Jordan", "Sidney"),
    ("cyrillic", "f"): ("Вера", "Нина", "Ирина", "Софья", "Дарья", "Полина", "Лидия", "Раиса"),
    ("cyrillic", "m"): ("Пётр", "Олег", "Павел", "Виктор", "Роман", "Фёдор", "Глеб", "Тимур"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Тоня", "Миша"),
    ("greek", "f"): ("Σοφία", "Άννα", "Ειρήνη", "Δήμητρα"),
    ("greek", "m"): ("Πέτρος", "Ανδρέας", "Στέφανος", "Μάριος"),
    ("greek", "n"): ("Φώτης", "Χάρης", "Άρης", "Μίνως"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fel", "gor", "hal", "kin", "lan", "mer", "nor", "pel", "ros", "sten", "tor", "vin", "wel", "zan"),
    "cyrillic": ("ба", "вер", "гор", "дан", "зор", "кал", "лес", "мор", "нев", "пол", "рад", "сав", "тим", "фед", "хор", "чер"),
    "greek": ("βα", "γεν", "δρα", "ζαν", "θεο", "καλ", "λαμ", "μαν", "νικ", "παν", "ραλ", "σαρ", "τασ", "φιλ", "χαρ", "ψαλ"),
}
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "o", ("latin", "n"): "e", ("latin", "s"): "", ("cyrillic", "f"): "а", ("cyrillic", "m"): "", ("cyrillic", "n"): "я", ("cyrillic", "s"): "ов", ("greek", "f"): "α", ("greek", "m"): "ος", ("greek", "n"): "ης", ("greek", "s"): "ίδης"}
#: A format holds its own surrogates while this many times the entities it has fit into it.
ROOM = 16
#: From this attempt on surrogates get a character longer each time, so that attempts end in any case.
LONGER_FROM = 16
#: Two-digit and one-digit country codes of telephone numbers; all others have three digits. Fixed values.
COUNTRY_CODE = r"^\+(?:1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|[0-9]{3})"

_titles = "|".join((*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES))


def _one_of(words: tuple[str, ...] | list[str]) -> str:
    """A pattern for any of the words that looks at each letter once, however many there are."""
    heads: dict[str, list[str]] = {}
    for w in set(words):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = [head + _one_of(tails) for head, tails in sorted(heads.items())]
    out = f"(?:{'|'.join(branches)})" if len(branches) > 1 or "" in words else "".join(branches)
    return f"{out}?" if "" in words and branches else "" if not branches else out


_given = _one_of([*FEMALE, *MALE, *given_names.NEUTRAL])
_before = rf"(?:(?:{'|'.join(PARTICLES)}) )*+"
_name = r"\p{Lu}[\p{L}'’-]{0,60}\p{L}(?![\p{L}\p{N}])"
#: A word of a name, or initials and the word they lead to. Possessive throughout: the engine doesn't
#: recurse, so a name may have any number of words, of 62 letters at most.
_word = rf"(?:\p{{Lu}}\. )*+{_before}{_name}"
_two = rf"{_word}(?: {_word})++"
_known = r"(?<=(?:[Nn]ame|[Cc]ontact|[Aa]uthor|[Pp]atient|[Cc]ustomer|[Ee]mployee|[Aa]ttn|[Ss]igned|From|To|Cc): |(?:Dear|met|married|emailed|phoned|name is) |(?:[Rr]egards|[Ss]incerely),[ \n])"
_acts = r"(?= (?:met|married|emailed|phoned|was born|is survived by|lives in|lived in)(?![\p{L}\p{N}])| \((?:born|aged|b\.) |, aged [0-9])"
_bodies = r"(?!(?:\p{Lu}\p{L}+ )?(?:The|This|Our|All|New|United|National|General|Public|White|Customer|Service|Services|Support|Sales|Team|Department|Ministry|Office|House|Nations|States|Company|Group|Board|Council|Committee|University|College|School|Bank|Party|Press|Court|Union|Church|City|Street|Sir|Madam)(?!\p{L}))"
#: A title or a given name, and all words of a name that follow; or two or more words where the text
#: beside them speaks of a person. A title after titles begins no name of its own: what fails there
#: failed at the first of them.
NAME = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:(?<!(?<![\p{{L}}\p{{N}}])(?:{_titles})\.? )(?:(?:{_titles})\.? )++{_word}|{_given}(?:-\p{{Lu}}\p{{L}}+){{0,8}}+ {_word})(?: {_word})*+|{_bodies}(?:{_known}{_two}|{_name} {_name}{_acts}))"
_octet = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_value = r"(?=[A-Za-z0-9+/_.-]*[0-9])[A-Za-z0-9+/_.-]{5,}[A-Za-z0-9+/_-]"
_numbered = r"(?:[Ss]ection|[Cc]hapter|[Vv]ersion|[Rr]elease|[Ff]igure|[Tt]able|[Cc]lause|[Pp]aragraph|[Aa]rticle|[Ss]tep|[Pp]art)"
#: An address has 64 characters before the @ at most, and its domain 127 labels of 63, as mail and
#: DNS bound them: the engine recurses over labels, and so no deeper than that.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}",
    "secret": rf"(?<![A-Za-z])(?:(?:[Pp]assword|PASSWORD|[Pp]asswd)(?: ?[=:] ?)|(?:[Ss]ecret|SECRET|[Tt]oken|TOKEN|api_?key|API_?KEY)(?: ?= ?| ?: ?(?![A-Za-z]+[0-9]{{0,3}}(?![A-Za-z0-9+/_-]))))[\"']?{_value}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![A-Za-z0-9.])(?<!{_numbered} )(?:{_octet}\.){{3}}{_octet}(?![0-9])(?!\.[0-9])(?!(?<=[^0-9][0-9]\.[0-9]\.[0-9]\.[0-9]|^[0-9]\.[0-9]\.[0-9]\.[0-9]) {_numbered})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9+])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "name": NAME,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What tells the kind of a mention, once it is found; all others are names. A number that is no
#: card's, by its check digit, is `plain` and stays.
TELLS = {
    "email": "@",
    "secret": "^[A-Za-z_]+ ?[=:]",
    "key": "^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_|sk-)",
    "hex": "^[0-9a-f]{32,}$",
    "iban": "^[A-Z]{2}[0-9]{2}",
    "ip": r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$",
    "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "phone": "^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$",
    "card": "^[0-9]",
}


def mentions(text: Column) -> Column:
    """The mentions in a text, in order. Texts without digit, @, head of a key and name are left at once."""
    maybe = text.rlike("[0-9@]|AKIA|gh[pousr]_|sk-") | text.rlike(NAME)
    return F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def _luhn(digits: Column) -> Column:
    """The check digit to follow these digits."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return ((10 - F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10) % 10).cast("string")


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an IBAN."""
    text = F.concat(account, country, F.lit("00"))

    def step(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 65, (rest * 10 + n - 48) % 97).otherwise((rest * 100 + n - 55) % 97)

    return F.lpad((98 - F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))).cast("string"), 2, "0")


def _kind(mention: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, pattern in TELLS.items():
        if kind == "card":
            digits = F.regexp_replace(mention, "[^0-9]", "")
            valid = F.substring(digits, -1, 1) == _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1))
            out = out.when(mention.rlike(pattern), F.when(valid, "card").otherwise("plain"))
        else:
            out = out.when(mention.rlike(pattern), F.lit(kind))
    return out.otherwise(F.lit("name"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _parts(mention: Column, kind: Column) -> Column:
    """The entities of a mention: (lead, kind, canonical form, shown form)."""
    lead_secret = F.regexp_extract(mention, r"^(?:[A-Za-z_]+)(?: ?[=:] ?)[\"']?", 0)

    def part(lead: Column, k: Column, canon: Column, shown: Column) -> Column:
        return F.struct(lead.alias("lead"), k.alias("kind"), canon.alias("canon"), shown.alias("shown"))

    titles = F.regexp_extract(mention, rf"^(?:(?:{_titles})\.? )*", 0)
    gender = F.when(titles.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\b|\s(?:{'|'.join(FEMALE_TITLES)})\b"), F.lit("f")).when(titles.rlike(rf"^(?:{'|'.join(MALE_TITLES)})\b|\s(?:{'|'.join(MALE_TITLES)})\b"), F.lit("m"))
    names = F.regexp_extract_all(F.substring(mention, F.length(titles) + 1, F.length(mention)), F.lit(rf"{_before}[^ ]+"), F.lit(0))
    women, men = [tuple(set(a) - given_names.NEUTRAL) for a in (FEMALE, MALE)]

    def named_part(name: Column, i: Column, whole: Column) -> Column:
        before = F.regexp_extract(name, f"^{_before}", 0)
        word = F.substring(name, F.length(before) + 1, F.length(name))
        first = F.substring_index(word, "-", 1)
        own = F.when(first.isin(*women), F.lit("f")).when(first.isin(*men), F.lit("m"))
        k = F.when(i == whole["n"] - 1, F.concat(F.lit("surname:"), _script(word))).otherwise(F.concat(F.lit("given:"), _script(word), F.lit(":"), F.coalesce(whole["gender"], own, F.lit("n"))))
        return part(F.concat(F.when(i == 0, whole["titles"]).otherwise(F.lit(" ")), before), k, word, word)

    # bound once: what is read off a name of very many words is not read anew for each of them
    found = F.transform(F.array(F.struct(names.alias("names"), titles.alias("titles"), gender.alias("gender"))), lambda w: F.struct(w["names"].alias("names"), w["titles"].alias("titles"), w["gender"].alias("gender"), F.size(w["names"]).alias("n")))
    named = F.transform(found, lambda w: F.transform(w["names"], lambda name, i: named_part(name, i, w)))[0]
    empty = F.lit("")
    return (
        F.when(kind == "name", named)
        .when(kind == "secret", F.array(part(lead_secret, F.lit("secret"), F.substring(mention, F.length(lead_secret) + 1, F.length(mention)), F.substring(mention, F.length(lead_secret) + 1, F.length(mention)))))
        .when(kind == "phone", F.array(part(empty, kind, F.concat(F.when(mention.startswith("+"), F.lit("+")).otherwise(F.lit("+1")), F.regexp_replace(mention, "[^0-9]", "")), mention)))
        .when(kind.isin("card", "ssn"), F.array(part(empty, kind, F.regexp_replace(mention, "[^0-9]", ""), mention)))
        .when(kind == "iban", F.array(part(empty, kind, F.regexp_replace(mention, " ", ""), mention)))
        .when(kind == "email", F.array(part(empty, kind, F.lower(mention), mention)))
        .otherwise(F.array(part(empty, kind, mention, mention)))
    )


def _hash(key: Column, *salt: Column) -> Column:
    """64 hexadecimal digits that only the key's holder can compute: an inner and an outer hash."""
    inner = F.sha2(F.concat_ws("\u0001", key, *salt), 256)
    return F.sha2(F.concat_ws("\u0001", F.lit("outer"), key, inner), 256)


def _same_classes(canon: Column, digest: Column, hexadecimal: Column) -> Column:
    """Each digit, small and capital letter by one of its class, the rest as it is."""

    def one(c: Column, i: Column, hashed: Column) -> Column:
        n = F.conv(F.substring(hashed["d"], (i * 2 % 126 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + i * 7
        pick = lambda chars: F.substring(F.lit(chars), (F.pmod(n, F.lit(len(chars))) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("[0-9a-f]") & hashed["h"], pick("0123456789abcdef")).when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    # bound once, as a lambda's body is computed anew for each character
    once = F.array(F.struct(digest.alias("d"), hexadecimal.alias("h")))
    return F.transform(once, lambda b: F.array_join(F.transform(F.split(canon, ""), lambda c, i: one(c, i, b)), ""))[0]


def _free(kind: Column, canon: Column) -> Column:
    """The part of an entity that its surrogate has in other characters of the same classes."""
    return (
        F.when(kind == "card", F.substring(canon, F.lit(3), F.length(canon)))
        .when(kind == "phone", F.regexp_replace(canon, COUNTRY_CODE, ""))
        .when(kind == "iban", F.substring(canon, F.lit(5), F.length(canon)))
        .when(kind == "key", F.regexp_replace(canon, "^(?:AKIA|gh[pousr]_|sk-)", ""))
        .when(kind == "email", F.substring_index(canon, "@", 1))
        .otherwise(canon)
    )


def shape(kind: Column, canon: Column) -> Column:
    """What entities share that have the same surrogates to choose from."""
    named = kind.rlike("^(?:given|surname):|^ip$")
    rest = F.when(kind == "email", F.substring_index(canon, "@", -1)).when(kind == "phone", F.regexp_extract(canon, COUNTRY_CODE, 0)).when(kind.isin("card", "iban", "key"), F.substring(canon, 1, 2)).otherwise("")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(_free(kind, canon), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    hexadecimal = kind.isin("hex", "secret") & canon.rlike("^[0-9a-f]+$")
    return F.when(named, F.lit("")).otherwise(F.concat_ws("|", rest, F.when(hexadecimal, F.length(canon).cast("string")).otherwise(classes)))


def _extra(kind: Column, canon: Column, crowd: Column) -> Column:
    """Characters that surrogates have over their entities, for `crowd` entities of the same shape."""
    free = _free(kind, canon)
    count = lambda pattern: F.regexp_count(free, F.lit(pattern))
    hexadecimal = kind.isin("hex", "secret") & canon.rlike("^[0-9a-f]+$")
    room = F.when(hexadecimal, count("[0-9a-f]") * F.lit(math.log10(16))).otherwise(count("[0-9]") + count("[A-Za-z]") * F.lit(math.log10(26)))
    lacks = F.greatest(F.log10(crowd * ROOM) - room, F.lit(0.0))
    return F.when(kind.rlike("^(?:given|surname):"), F.ceil(F.log10(crowd * ROOM) / math.log10(16))).when(kind == "ip", F.ceil(F.greatest(F.log10(crowd * ROOM) - 9.5, F.lit(0.0)))).otherwise(F.ceil(lacks)).cast("int")


def _number(digest: Column, at: int, most: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, at, 8), 16, 10).cast("long"), F.lit(most)).cast("int")


def _invented(digest: Column, script: str, sort: str, syllables: Column) -> Column:
    """A name of so many syllables."""
    table = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    chosen = F.transform(F.sequence(F.lit(1), syllables), lambda i: F.element_at(table, F.conv(F.substring(digest, (i * 3).cast("int"), F.lit(1)), 16, 10).cast("int") + 1))
    return F.concat(F.initcap(F.array_join(chosen, "")), F.lit(ENDINGS[script, sort]))


def surrogate(kind: Column, canon: Column, extra: Column, attempt: int, key: Column) -> Column:
    """The canonical form of an entity's surrogate. extra: of _extra()."""
    digest = F.concat(_hash(key, kind, canon, F.lit(attempt), F.lit("a")), _hash(key, kind, canon, F.lit(attempt), F.lit("b")))
    longer = extra + max(0, attempt - LONGER_FROM + 1)
    digits = F.translate(F.concat(F.reverse(digest), digest), "abcdef", "385061")
    more = F.substring(digits, F.lit(1), longer)
    free = _free(kind, canon)
    new = F.concat(_same_classes(free, digest, kind.isin("hex", "secret") & canon.rlike("^[0-9a-f]+$")), more)
    body = F.concat(F.substring(canon, 1, 1), F.substring(new, F.lit(1), F.length(new)))
    card = F.concat(body, _luhn(body))
    country = F.substring(canon, 1, 2)
    valid = F.substring(canon, 3, 2) == _iban_check(country, free)
    iban = F.concat(country, F.when(valid, _iban_check(country, new)).otherwise(F.substring(digits, 30, 2)), new)
    domain = F.substring_index(canon, "@", -1)
    own = _hash(key, F.lit("domain"), domain)  # people of one domain stay of one domain
    label = lambda x: F.when(x.isin("example", "test", "invalid", "localhost"), x).otherwise(_same_classes(x, F.concat(own, own), F.lit(False)))
    labels = F.split(domain, r"\.")
    email = F.concat(new, F.lit("@"), F.array_join(F.transform(labels, lambda x, i: F.when(i == F.size(labels) - 1, x).otherwise(label(x))), "."))
    # IPv4 has no longer form: where its addresses run out, IPv6 of the range for documentation
    ip4 = F.concat_ws(".", *[(_number(digest, 1 + 8 * k, 223 if k == 0 else 254) + 1).cast("string") for k in range(4)])
    ip = F.when(longer == 0, ip4).otherwise(F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(digest, 1 + 4 * k, 4)) for k in range(6)]))
    out = F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "email", email)
    out = out.when(kind.isin("phone", "key"), F.concat(F.substring(canon, F.lit(1), F.length(canon) - F.length(free)), new))
    for script in SYLLABLES:
        out = out.when(kind == f"surname:{script}", _invented(digest, script, "s", F.greatest(longer, F.lit(3))))
        for gender in "fmn":
            list_ = GIVEN[script, gender]
            if attempt == 0:
                name = F.element_at(F.array(*[F.lit(n) for n in list_]), _number(digest, 1, len(list_)) + 1)
            else:
                name = _invented(digest, script, gender, F.greatest(longer, F.lit(2)))
            out = out.when(kind == f"given:{script}:{gender}", name)
    return out.otherwise(new)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, distinct; a stored table) with the surrogate of each. Kinds of given
    names and of surnames are apart, so a name keeps its distinctness in both parts."""
    secret = F.lit(key)
    taken = entities.select(F.col("kind").alias("k"), F.col("canon").alias("s"))
    shaped = stored(entities.withColumn("shape", shape(F.col("kind"), F.col("canon"))))
    crowds = stored(shaped.groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("crowd")))
    sized = join_skewed(shaped, crowds, ["kind", "shape"]).select("kind", "canon", _extra(F.col("kind"), F.col("canon"), F.col("crowd")).alias("extra"))
    pending, settled = stored(sized), None
    for attempt in count():
        tried = stored(pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("extra"), attempt, secret)))
        free = tried.join(taken, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s")), "left_anti")
        won = stored(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"))
        settled = won if settled is None else settled.unionByName(won)
        pending = stored(tried.join(won, ["kind", "canon"], "left_anti").drop("surrogate"))
        if pending.isEmpty():
            break
        taken = taken.unionByName(won.select(F.col("kind").alias("k"), F.col("surrogate").alias("s")))
    return settled


def _shown(shown: Column, canon: Column, kind: Column, new: Column) -> Column:
    """A surrogate in the mention's own format: numbers take its punctuation."""
    # a number without a country code is one of +1, which it doesn't show
    chars = F.when(kind == "phone", F.substring(new, F.when(shown.startswith("+"), 2).otherwise(3), F.length(new))).otherwise(new)
    places = F.length(F.regexp_replace(shown, "[^0-9A-Z]", ""))

    def digit(done: Column, c: Column) -> Column:
        here = c.rlike("[0-9A-Z]")
        nth = done["n"] + F.when(here, 1).otherwise(0)
        return F.struct(nth.alias("n"), F.concat(done["t"], F.when(here, F.substring(chars, nth, F.lit(1))).otherwise(c)).alias("t"))

    filled = F.aggregate(F.split(shown, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), digit, lambda d: d["t"])
    filled = F.concat(filled, F.substring(chars, places + 1, F.length(chars)))
    return F.when(kind == "plain", shown).when(kind.isin("phone", "card", "ssn", "iban"), filled).otherwise(new)


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs, all columns, with each mention in text replaced, and n_replaced added. key: a secret;
    the same key gives the same surrogates for the same corpus. A null text stays null with 0; a
    text without mentions stays as it is. Rows that repeat are replaced alike. A document's mentions
    are put together again in one row; nothing gathers more than that."""
    if not key:
        raise ValueError("surrogates need a secret key")
    row = F.xxhash64("text")
    names, needed = docs.columns, ("doc_id", "text")
    with_text = shielded(docs, needed).withColumn("text", F.col("text").cast("string"))
    found = stored(with_text.select(F.col("doc_id").alias("__d"), row.alias("__h"), mentions(F.col("text")).alias("m")).where(F.size("m") > 0).dropDuplicates(["__d", "__h"]))
    each = found.select("__d", "__h", F.posexplode("m").alias("at", "mention")).withColumn("k", _kind(F.col("mention")))
    each = each.select("__d", "__h", "at", F.posexplode(_parts(F.col("mention"), F.col("k"))).alias("nth", "p")).select("__d", "__h", "at", "nth", "p.*")
    each = stored(each)
    # very many documents may mention one entity
    entities = stored(each.where("kind <> 'plain'").select("kind", "canon").distinct())
    chosen = stored(assign(entities, key))
    shown = join_skewed(each, chosen, ["kind", "canon"], "left").withColumn("new", F.concat("lead", _shown(F.col("shown"), F.col("canon"), F.col("kind"), F.col("surrogate"))))
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "new"))), lambda p: p["new"]), "")
    shown = shown.groupBy("__d", "__h", "at").agg(put.alias("new"), F.max((F.col("kind") != "plain").cast("long")).alias("n"))
    whole = shown.groupBy("__d", "__h").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("all"), F.sum("n").alias("n_replaced"))
    joined = with_text.withColumn("__th", row).join(whole, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__h")), "left")
    # the n-th mention follows the n-th piece; the last piece has none
    pieces = F.transform(F.split(F.col("text"), ANY, -1), lambda s, i: F.concat(s, F.coalesce(F.get(F.col("all"), i)["new"], F.lit(""))))
    text = F.when(F.col("all").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    done = joined.withColumn("text", text).withColumn("n_replaced", F.coalesce("n_replaced", F.lit(0)).cast("long"))
    return restored(done, names, needed, ("n_replaced",))
