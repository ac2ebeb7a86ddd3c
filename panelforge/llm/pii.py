"""PII surrogates with SQL functions only.

Entities (e-mail addresses, phone, card and social security numbers, IBANs, IPv4 addresses, long hexadecimal secrets,
access keys, values given to a password, token or key, and person names after a title, a known given name or a cue
such as "name:") are cut out of the text by one pattern and replaced by keyed surrogates of the same type: the same
shape, letter case, country code, card issuer digit and Luhn remainder, IBAN country and valid check digits, issued
number ranges, private or public address range, script and gender. A surrogate is a function of (key, type, canonical
form, attempt), so one entity gets one surrogate in every document and every spelling; a surname that a document
writes with a title or given name is also replaced where it stands alone there.

A first pass finds the entities of each text and stores them beside it; their distinct canonical forms are gathered,
and a proposed surrogate that equals a real entity or another's surrogate is proposed anew with the next attempt, until
all are distinct. Given names on no list are entities of their own, so whole names stay distinct. A format that is full
grows: from the WIDER-th attempt on, numbers gain digits and addresses leave their range. Only entities with an
attempt above zero need to be looked up in the second pass.

Defined results: null text stays null; text without entities is returned unchanged; repeated rows and rows with a null
id get equal texts for equal texts; extra columns pass; an n_chars column follows the new text; empty tables give empty
tables.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import nested, only, restored, stored, table

#: Where a run of word characters, hyphens and the like begins or ends.
WORD_EDGE = r"(?<=[\p{L}\p{N}_@-])(?![\p{L}\p{N}_@-])|(?<![\p{L}\p{N}_@-])(?=[\p{L}\p{N}_@-])"
KEY = "panelforge surrogate key"
#: Attempts after which a format counts as full and grows by a step, and again each time.
WIDER = 6

# Titles, given names and syllables by gender and script.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Signor Senhor Г-н Господин Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Fräulein Madame Mademoiselle Señora Señorita Signora Senhora Г-жа Госпожа Κυρία".split(),
    "n": "Dr Prof Professor Doctor Doktor".split(),
}
GIVEN = {
    ("latin", "m"): "Michael Robert William Richard Thomas Charles Daniel Matthew Anthony Steven Andrew Joshua Kenneth Kevin Brian George Edward Ronald Wolfgang Jürgen Stefan Heinrich Pierre Philippe François Laurent Carlos Fernando Alejandro Javier James John David Joseph Christopher Paul Donald Timothy Jason Jeffrey Jacob Nicholas Jonathan Stephen Benjamin Samuel Patrick Alexander Peter Henry Martin Hans Klaus Jürg Friedrich Johannes Andreas Michel Jacques Antoine Nicolas José Juan Luis Miguel Antonio Manuel Pedro Pablo Diego Giovanni Marco Giuseppe Luca Ahmed Mohammed Omar".split(),
    ("latin", "f"): "Jennifer Patricia Elizabeth Barbara Susan Jessica Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Ursula Monika Sabine Brigitte Isabelle Catherine Françoise Nathalie Carmen Guadalupe Beatriz Lucía Mary Maria María Linda Sarah Karen Lisa Nancy Betty Kimberly Laura Cynthia Dorothy Amy Angela Sharon Anna Helen Nicole Samantha Katherine Christine Rachel Carolyn Janet Julia Hannah Sophia Olivia Emma Petra Claudia Gisela Heike Katharina Marie Sophie Camille Claire Élise Ana Isabel Pilar Rosa Elena Giulia Francesca Fatima Aisha".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Николай Владимир Михаил Андрей Алексей Виктор Павел".split(),
    ("cyrillic", "f"): "Екатерина Татьяна Наталья Светлана Людмила Марина Галина Ирина Ольга Елена".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Κωνσταντίνος Ιωάννης Νικόλαος Παναγιώτης Βασίλειος Αθανάσιος".split(),
    ("greek", "f"): "Αικατερίνη Βασιλική Ελένη Γεωργία Σοφία Αναστασία Ευαγγελία Δήμητρα".split(),
}
GIVEN_ENDS = {"latin": ("n", "th"), "cyrillic": ("н", "сь"), "greek": ("ς", "ξ")}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le ma mo".split(),
    "cyrillic": "ба бо ва ве га го да де ка ко ла ле ма мо на ро".split(),
    "greek": "βα βο γα γε δα δο κα κο λα λε μα μο να ρο σα τα".split(),
}

_EDGE = r"(?<![\p{L}\p{N}_.+%@-])"
_CAPITALISED = r"\p{Lu}(?:\p{Ll}+|\p{Lu}+)"
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,8}\.[A-Za-z]{2,24}"
SECRET = r"[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])"
# Prefixes of common access keys.
_KEY_PREFIX = r"(?:A[KS]IA|gh[pos]_|sk-)"
ACCESS_KEY = rf"{_KEY_PREFIX}[A-Za-z0-9]{{16,64}}(?![A-Za-z0-9])"
#: The one-character look behind fails at nearly every word before the longer one is tried.
CREDENTIAL = r"(?<=[=:\"']|[=:] )(?<=(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_-]{8,128}"
IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"


def _alternatives(words: list[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_GIVEN_ALL = [n for names in GIVEN.values() for n in names]
_TITLES_ALL = [t for ts in TITLES.values() for t in ts]
_TITLE = rf"(?:{_alternatives(_TITLES_ALL)})"
_KNOWN = rf"(?:{_alternatives(_GIVEN_ALL)})"
_WORD = rf"{_CAPITALISED}(?:-{_CAPITALISED})?(?!\p{{L}})"
_MIDDLE = rf"(?: (?:{_KNOWN}(?!\p{{L}})|\p{{Lu}}\.))"
# What announces a name.
_CUE = r"(?i:name: |name is |regards,\s|sincerely,\s|signed by |patient: |employee: |customer: |contact: |attn: )"
NAME = rf"(?=\p{{Lu}})(?:{_TITLE}\.?{_MIDDLE}{{0,3}}(?: {_WORD}){{1,3}}|{_KNOWN}{_MIDDLE}{{0,3}} {_WORD}|(?<={_CUE}){_WORD}{_MIDDLE}{{0,2}} {_WORD})"
# Country codes of one and two digits; all others have three.
COUNTRY_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: E-mail first: its local part may look like anything else. Digits before names, as they fail fastest.
PATTERN = rf"{_EDGE}(?:{EMAIL}|{CREDENTIAL}|{ACCESS_KEY}|{SECRET}|{IPV4}|{SSN}|{CARD}|{PHONE}|{IBAN}|{NAME})"
#: What any entity must contain; most texts stop here.
HINT = rf"@|[=:]\s{{0,2}}[\"']?[A-Za-z0-9+/_-]{{8}}|{_KEY_PREFIX}[A-Za-z0-9]{{16}}|[0-9][0-9. ()-]{{6}}|\+[0-9]|(?<![0-9A-Za-z])[0-9A-Fa-f]{{32}}|[A-Z]{{2}}[0-9]{{2}}|(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLE}|{_KNOWN})\.? \p{{Lu}}|{_CUE}\p{{Lu}}"

_KINDS = [
    ("email", EMAIL), ("ipv4", IPV4), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("key", ACCESS_KEY),
    ("iban", IBAN), ("secret", "[0-9A-Fa-f]{8,128}"), ("credential", "[A-Za-z0-9+/_-]{8,128}"),
]


def _full(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def kind_of(match: Column) -> Column:
    """The type of a matched entity; names carry their script."""
    found = F
    for name, pattern in _KINDS:
        found = found.when(match.rlike(_full(pattern)), F.lit(name))
    found = found.when(match.rlike(r"\p{IsCyrillic}"), F.lit("name:cyrillic")).when(match.rlike(r"\p{IsGreek}"), F.lit("name:greek"))
    return found.otherwise(F.lit("name:latin"))


def _surname(match: Column) -> Column:
    return F.element_at(F.split(match, " "), -1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _national(match: Column) -> Column:
    """Digits of a phone number after its country code and a colon; ten digits after the code 1 stand alone."""
    digits = _digits(match)
    code = _digits(F.regexp_extract(match, COUNTRY_CODE, 0))
    rest = F.substr(digits, F.length(code) + 1, F.length(digits))
    return F.when((code == "") | (code == "1") & (F.length(digits) == 11), rest).otherwise(F.concat(code, F.lit(":"), rest))


def canonical(match: Column, kind: Column) -> Column:
    """What all spellings of one entity share."""
    return (
        F.when(kind.isin("card", "ssn"), _digits(match))
        .when(kind == "phone", _national(match))
        .when(kind.startswith("name"), F.lower(_surname(match)))
        .when(kind.isin("key", "credential"), match)
        .when(kind == "iban", F.upper(F.replace(match, F.lit(" "), F.lit(""))))
        .otherwise(F.lower(match))
    )


# --- surrogates ----------------------------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once; it also keeps long expressions from being written out repeatedly."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(text: Column, change) -> Column:
    """The text with each character (and its place from one) changed."""
    places = F.sequence(F.lit(1), F.length(text))
    return F.array_join(F.transform(places, lambda i: change(F.substr(text, i, F.lit(1)), i)), "")


def _stream(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits from a keyed hash."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *parts), 512)


def _as_digits(stream: Column) -> Column:
    return F.translate(stream, "abcdef", "270531")


def _as_letters(stream: Column) -> Column:
    return F.translate(stream, "0123456789abcdef", "bcdfghklmnprstvz")


def _at(stream: Column, i: Column) -> Column:
    return F.substr(stream, (i - 1) % 128 + 1, F.lit(1))


def _shaped(text: Column, stream: Column) -> Column:
    """Letters for letters, capitals for capitals and digits for digits."""

    def change(c: Column, letters: Column, digits: Column, i: Column) -> Column:
        letter = _at(letters, i)
        return F.when(c.rlike("[A-Z]"), F.upper(letter)).when(c.rlike("[a-z]"), letter).when(c.rlike("[0-9]"), _at(digits, i)).otherwise(c)

    both = F.struct(_as_letters(stream).alias("letters"), _as_digits(stream).alias("digits"), text.alias("text"))
    return _let(both, lambda b: _chars(b["text"], lambda c, i: change(c, b["letters"], b["digits"], i)))


def _key(canon: Column, stream: Column) -> Column:
    prefix = F.regexp_extract(canon, "^" + _KEY_PREFIX, 0)
    return F.concat(prefix, _shaped(F.substr(canon, F.length(prefix) + 1, F.length(canon)), stream))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counted plainly."""
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weight), F.lit(0), lambda a, b: a + b)


def _card(canon: Column, stream: Column) -> Column:
    n = F.length(canon)
    body = F.concat(F.substring(canon, 1, 1), F.substr(_as_digits(stream), F.lit(1), n - 2))
    check = lambda b: F.pmod(_luhn(canon) - _luhn(F.concat(b, F.lit("0"))), F.lit(10))
    return _let(body, lambda b: F.concat(b, check(b).cast("string")))


def _from(stream: Column, at: int, low: int, high: int, width: int = 0) -> Column:
    """A number between low and high from eight digits of the stream, padded to the width."""
    number = F.conv(F.substring(stream, at, 8), 16, 10).cast("long") % (high - low + 1) + low
    return F.lpad(number.cast("string"), width, "0") if width else number.cast("string")


def _extra(stream: Column, attempt: Column) -> Column:
    """The digits that a full format gains: two for each WIDER attempts."""
    return F.substr(F.reverse(_as_digits(stream)), F.lit(1), 2 * F.floor(attempt / WIDER).cast("int"))


def _ssn(stream: Column) -> Column:
    """Nine digits in the ranges that are issued."""
    return F.concat(_from(stream, 1, 1, 665, 3), _from(stream, 9, 1, 99, 2), _from(stream, 17, 1, 9999, 4))


def _phone(canon: Column, stream: Column) -> Column:
    """The country code and colon kept; ten digits without them have no 0 or 1 at the head of area code and exchange."""
    code = F.regexp_extract(canon, "^[0-9]{1,3}:", 0)
    national = F.concat(_from(stream, 1, 200, 999), _from(stream, 9, 200, 999), _from(stream, 17, 0, 9999, 4))
    plain = F.concat(code, F.substr(_as_digits(stream), F.lit(1), F.length(canon) - F.length(code)))
    return F.when((code == "") & (F.length(canon) == 10), national).otherwise(plain)


def _iban(canon: Column, stream: Column) -> Column:
    """The country, check digits that make the whole leave 1 on division by 97, and an account of the same shape."""
    country, account = F.substring(canon, 1, 2), _shaped(F.substr(canon, F.lit(5), F.length(canon)), stream)

    def step(left: Column, c: Column) -> Column:
        return _let(F.conv(c, 36, 10).cast("int"), lambda d: (left * F.when(d > 9, 100).otherwise(10) + d) % 97)  # A is 10

    def whole(body: Column) -> Column:
        ordered = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
        return F.concat(country, F.lpad((98 - F.aggregate(ordered, F.lit(0), step)).cast("string"), 2, "0"), body)

    return _let(account, whole)


def _octet(stream: Column, i: int, low: int, high: int) -> Column:
    return (F.conv(F.substring(stream, 4 * i + 1, 4), 16, 10).cast("int") % (high - low + 1) + low).cast("string")


def _ipv4(canon: Column, stream: Column, attempt: Column) -> Column:
    """Inside its private range; where that is full first in 10.0.0.0/8, then anywhere."""
    rest = [_octet(stream, i, 1, 254) for i in (1, 2, 3)]
    kept = F.regexp_extract(canon, r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.", 0)
    kept = F.when((attempt < WIDER) | (kept == ""), kept).when(attempt < 2 * WIDER, F.lit("10.")).otherwise(F.lit(""))
    private = F.when(kept.rlike(r"\..*\."), F.concat(kept, F.concat_ws(".", *rest[:2]))).otherwise(F.concat(kept, F.concat_ws(".", *rest)))
    first = _octet(stream, 0, 11, 126)
    return F.when(kept != "", private).otherwise(F.concat_ws(".", first, *rest))


def _email(canon: Column, stream: Column, key: str) -> Column:
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    short = F.substr(_as_letters(stream), F.lit(100), F.greatest(F.lit(0), 8 - F.length(local)))
    return F.concat(_shaped(local, stream), short, F.lit("@"), _shaped(host, _stream(key, F.lit("domain"), domain)), F.lit("."), top)


def _name(stream: Column, kind: Column, attempt: Column) -> Column:
    """Four syllables, and one more for each WIDER attempts."""

    def spelt(script: str) -> Column:
        table_ = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        count = F.lit(4) + F.floor(attempt / WIDER).cast("int")
        return F.array_join(
            F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(table_, F.conv(F.substr(stream, i, F.lit(1)), 16, 10).cast("int") + 1)), ""
        )

    return F.when(kind.endswith(":cyrillic"), spelt("cyrillic")).when(kind.endswith(":greek"), spelt("greek")).otherwise(spelt("latin"))


def core(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The canonical form of the surrogate."""
    given = F.struct(kind.alias("kind"), canon.alias("canon"), attempt.alias("attempt"), _stream(key, kind, canon, attempt.cast("string")).alias("stream"))
    return _let(given, lambda g: _core(g["kind"], g["canon"], g["attempt"], g["stream"], key))


def _core(kind: Column, canon: Column, attempt: Column, stream: Column, key: str) -> Column:
    n = F.length(canon)
    plain = (
        F.when(kind == "card", _card(canon, stream))
        .when(kind == "ssn", _ssn(stream))
        .when(kind == "phone", _phone(canon, stream))
        .when(kind == "secret", F.substr(stream, F.lit(1), n))
        .when(kind == "key", _key(canon, stream))
        .when(kind == "credential", _shaped(canon, stream))
        .otherwise(_iban(canon, stream))
    )
    return (
        F.when(kind == "email", _email(F.concat(_extra(stream, attempt), canon), stream, key))
        .when(kind == "ipv4", _ipv4(canon, stream, attempt))
        .when(kind.startswith("name") | kind.startswith("given"), _name(stream, kind, attempt))
        .otherwise(F.concat(plain, _extra(stream, attempt)))
    )


def _filled(match: Column, digits: Column) -> Column:
    """The match with its digits replaced in turn, and behind it those it has no place for."""
    inside = _chars(match, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(match, F.lit(1), i))), F.lit(1))).otherwise(c))
    return F.concat(inside, F.substr(digits, F.length(_digits(match)) + 1, F.length(digits)))


def _cased(like: Column, text: Column) -> Column:
    return (
        F.when((F.upper(like) == like) & (F.lower(like) != like), F.upper(text))
        .when(F.substring(like, 1, 1) != F.lower(F.substring(like, 1, 1)), F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1000)))
        .otherwise(text)
    )


def _spaced(match: Column, text: Column) -> Column:
    """The text with the match's single spaces put back in their places, and behind it what the match has no place for."""
    bare = lambda t: F.length(F.replace(t, F.lit(" "), F.lit("")))
    inside = _chars(match, lambda c, i: F.when(c == " ", c).otherwise(F.substr(text, bare(F.substr(match, F.lit(1), i)), F.lit(1))))
    return F.concat(inside, F.substr(text, bare(match) + 1, F.length(text)))


def _moved(names: list[str], key: str) -> list[str]:
    """The names in keyed order. Each is replaced by the next one: one to one, and none stays."""
    return sorted(dict.fromkeys(names), key=lambda n: hashlib.sha256(f"{key}\u0001{n}".encode()).digest())


def _front(match: Column) -> Column:
    """The words of a name before its last one."""
    words = F.split(match, " ")
    return F.slice(words, F.lit(1), F.size(words) - 1)


def _is_title(word: Column) -> Column:
    return F.regexp_replace(word, r"\.$", "").isin(_TITLES_ALL)


def _is_initial(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}\.$")


def unlisted_given(match: Column) -> Column:
    """The given names of a name that stand on no list."""
    return F.filter(_front(match), lambda w: ~_is_title(w) & ~_is_initial(w) & ~w.isin(_GIVEN_ALL))


def given_kind(kind: Column) -> Column:
    return F.replace(kind, F.lit("name:"), F.lit("given:"))


def _person(match: Column, kind: Column, surname: Column, tried, key: str) -> Column:
    """Title kept, listed given names moved inside their list (gender and script), others spelt in their script, and
    the surrogate surname in the case of the old one. tried(kind, canon) gives the attempt of a given name."""
    words = F.split(match, " ")
    title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")

    def given(word: Column) -> Column:
        woman = title.isin(TITLES["f"]) | (~title.isin(TITLES["m"]) & (F.crc32(F.lower(word).cast("binary")) % 2 == 0))
        # a name on no list: a spelt one, its end a consonant by gender, so that it equals no listed name
        own = given_kind(kind)
        ending = F.lit("")
        for script, (man_end, woman_end) in GIVEN_ENDS.items():
            ending = F.when(kind == f"name:{script}", F.when(woman, F.lit(woman_end)).otherwise(F.lit(man_end))).otherwise(ending)
        spelt = F.initcap(F.concat(core(own, F.lower(word), tried(own, F.lower(word)), key), ending))
        moved = [_moved(names, key) for names in GIVEN.values()]
        # initials move on in the alphabet
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        spelt = F.when(_is_initial(word), F.translate(word, letters, letters[7:] + letters[:7])).otherwise(spelt)
        after = F.create_map(*[F.lit(n) for ns in moved for pair in zip(ns, [*ns[1:], ns[0]], strict=True) for n in pair])
        changed = F.coalesce(after[word], spelt)
        return F.when(_is_title(word), word).otherwise(changed)

    return F.concat(F.array_join(F.transform(_front(match), given), " "), F.lit(" "), _cased(F.element_at(words, -1), surname))


def surrogate(match: Column, kind: Column, canon: Column, tried, key: str = KEY) -> Column:
    """The replacement for a matched entity, in its own format. tried(kind, canon) gives an entity's attempt."""
    entity = F.struct(match.alias("match"), kind.alias("kind"), core(kind, canon, tried(kind, canon), key).alias("value"))
    return _let(entity, lambda e: _written(e["match"], e["kind"], e["value"], tried, key))


def _written(match: Column, kind: Column, value: Column, tried, key: str) -> Column:
    """A surrogate's value in the format of the match."""
    prefix = F.when(match.startswith("+1") & (F.length(_digits(match)) == 11), F.lit("1")).otherwise(F.lit(""))
    return (
        F.when(kind.isin("card", "ssn"), _filled(match, value))
        .when(kind == "phone", _filled(match, F.concat(prefix, F.replace(value, F.lit(":"), F.lit("")))))
        .when(kind == "iban", _spaced(match, value))
        .when(kind.startswith("name"), _person(match, kind, value, tried, key))
        .when(kind.isin("key", "credential"), value)
        .otherwise(_cased(match, value))
    )


# --- on tables -----------------------------------------------------------------------------------------------------


def detected(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with __found: the entities of the text in order, as structs (match, kind, canon)."""
    matches = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)))
    kinds = F.transform(matches, lambda m: F.struct(m.alias("match"), kind_of(m).alias("kind")))
    return documents.withColumn(
        "__found", F.transform(kinds, lambda e: F.struct(e["match"].alias("match"), e["kind"].alias("kind"), canonical(e["match"], e["kind"]).alias("canon")))
    )


def _keys(found: Column) -> Column:
    """(kind, canon) of the entities of a text, and of the unlisted given names in them."""
    own = F.transform(found, lambda e: F.struct(e["kind"].alias("kind"), e["canon"].alias("canon")))
    named = F.filter(found, lambda e: e["kind"].startswith("name"))
    given = F.transform(
        named, lambda e: F.transform(unlisted_given(e["match"]), lambda w: F.struct(given_kind(e["kind"]).alias("kind"), F.lower(w).alias("canon")))
    )
    return F.concat(own, F.flatten(given))


def attempts(entities: DataFrame, key: str = KEY) -> DataFrame | None:
    """(kind, canon, attempt) of the entities whose first surrogate is taken; None if there are none."""
    entities = stored(entities)
    taken = entities.select("kind", F.col("canon").alias("value"))
    pending, later = entities, None
    for attempt in itertools.count():
        proposed = pending.withColumn("value", core(F.col("kind"), F.col("canon"), F.lit(attempt), key))
        free = proposed.join(taken, ["kind", "value"], "left_anti")
        won = free.groupBy("kind", "value").agg(F.min("canon").alias("canon"))
        lost = stored(pending.join(won, ["kind", "canon"], "left_anti"))
        if attempt:
            here = won.select("kind", "canon", F.lit(attempt).alias("attempt"))
            later = here if later is None else later.unionByName(here)
        if lost.isEmpty():
            return None if later is None else stored(later)
        taken = stored(taken.unionByName(won.select("kind", "value")))
        pending = lost


def _replaced(documents: DataFrame, key: str) -> DataFrame:
    """Rows (__row, text, __found, __text): the new text beside all old columns."""
    # the patterns run once: what they find is stored beside the rows
    rows = stored(detected(nested(documents, "text")))
    keyed = rows.where(F.size("__found") > 0).select(F.xxhash64("text").alias("__hash"), F.explode(_keys(F.col("__found"))).alias("e"))
    keyed = keyed.select("__hash", "e.kind", "e.canon")
    retried = attempts(keyed.select("kind", "canon").distinct(), key)
    if retried is None:
        rows = rows.withColumn("__attempts", F.lit(None).cast("map<string,int>"))
    else:
        # the retried entities of each text, by the text's hash; a shared hash only merges two lookups
        wanted = keyed.join(retried, ["kind", "canon"]).distinct()
        lookup = wanted.groupBy("__hash").agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "canon"), "attempt"))).alias("__attempts")
        )
        rows = rows.withColumn("__hash", F.xxhash64("text")).join(lookup, "__hash", "left").drop("__hash")

    def tried(kind: Column, canon: Column) -> Column:
        return F.coalesce(F.col("__attempts")[F.concat_ws("\u0001", kind, canon)], F.lit(0))

    def plain_name(e: Column) -> Column:
        return e["kind"].startswith("name") & (F.size(unlisted_given(e["match"])) == 0)

    # between two entities a surname may stand alone: (kind, surname as written), each once, and what replaces it
    written = F.transform(F.filter("__found", plain_name), lambda e: F.concat_ws("\u0001", e["kind"], _surname(e["match"])))
    rows = rows.withColumn("__names", F.array_distinct(written))
    kind, surname = (lambda n: F.substring_index(n, "\u0001", 1)), (lambda n: F.substring_index(n, "\u0001", -1))
    new = lambda n: core(kind(n), F.lower(surname(n)), tried(kind(n), F.lower(surname(n))), key)
    olds = F.transform("__names", surname)
    news = F.transform("__names", lambda n: _cased(surname(n), new(n)))
    rows = rows.withColumn("__alone", F.when(F.size("__names") > 0, F.map_from_arrays(F.array_distinct(olds), F.slice(news, F.lit(1), F.size(F.array_distinct(olds))))))

    def renamed(part: Column) -> Column:
        word = lambda w: F.when(w.rlike(r"^\p{Lu}"), F.coalesce(F.col("__alone")[w], w)).otherwise(w)
        return F.array_join(F.transform(F.split(part, WORD_EDGE, -1), word), "")

    between = F.split(F.col("text"), PATTERN, -1)
    between = F.when(F.col("__alone").isNotNull(), F.transform(between, renamed)).otherwise(between)
    made = F.transform("__found", lambda e: surrogate(e["match"], e["kind"], e["canon"], tried, key))
    woven = F.zip_with(between, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return rows.withColumn("__text", F.when(F.size("__found") > 0, F.array_join(woven, "")).otherwise(F.col("text")))


def with_surrogates(documents: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with every entity of the text replaced."""
    rows = _replaced(documents, key)
    changed = {"text": "__text"}
    if "n_chars" in documents.columns:
        length = F.when(F.size("__found") > 0, F.length("__text").cast("long")).otherwise(F.col("__row.n_chars"))
        rows = rows.withColumn("__n_chars", length)
        changed["n_chars"] = "__n_chars"
    return restored(rows, documents.columns, **changed)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return rows.select("__row.doc_id", F.col("__text").alias("text"), F.coalesce(F.size("__found"), F.lit(0)).cast("long").alias("n_entities"))
