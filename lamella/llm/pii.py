"""Surrogates for personal data: keyed, type-consistent replacements of the same form. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import cut

_MALE = r"(?:Mr|Herr|Señor|Sr|Monsieur|Signor|Г-н)"
_FEMALE = r"(?:Mrs|Ms|Miss|Frau|Señora|Señorita|Sra|Madame|Mme|Mlle|Signora|Г-жа)"
_NEUTRAL = r"(?:Dr|Prof|Mx)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Hyphens and apostrophes inside a name belong to it, a possessive s does not.
_NAME_WORD = r"\p{Lu}(?:[\p{L}\p{M}]|-(?=\p{L})|['’](?=\p{L})(?!s(?!\p{L})))+"
#: Phone numbers with a country code and 8 to 15 digits, groups apart or not; then national forms: North American, French,
#: Spanish, and those with an area code after a trunk 0 (British, German).
_PHONES = (
    r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"(?<![0-9+])\+(?:[1-9][0-9]{7,14}|[1-9][0-9]{0,2}[ ./-]?\([0-9]{1,5}\)(?:[ ./-]?[0-9]){6,10}|[1-9](?:[ ./-]?[0-9]){7,14})(?![0-9])",
    r"(?<![0-9+])(?<![0-9][.,])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9+])(?<![0-9][.,])0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})(?![0-9])",
    r"(?<![0-9+])(?<![0-9][.,])[6-9](?:[0-9]{2} [0-9]{2} [0-9]{2} [0-9]{2}|[0-9] [0-9]{3} [0-9]{2} [0-9]{2})(?![0-9])",
    r"(?<![0-9+])(?<![0-9][.,])(?!(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9]))(?:0[1-9][0-9]{1,4}(?: ?/ ?| |-)|\(0[1-9][0-9]{1,4}\) ?)(?:[0-9]{6,8}|[0-9]{3,4}[ -][0-9]{3,4}|[0-9]{3} [0-9]{2} [0-9]{2}|[0-9]{2}(?: [0-9]{2}){2,3})(?![0-9])",
)
#: Country codes: of one, two and, for all others, three digits.
_COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Entity patterns by type, the first that fits a match deciding its type.
PATTERNS = {
    "EMAIL": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]+)*\.\p{L}[\p{L}\p{M}]+",
    "SECRET": r"(?i:passw(?:or)?d|pwd|token|secret|api[_-]?key)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{8,}",
    "KEY": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "SSN": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "PHONE": "|".join(_PHONES),
    "CARD": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "IP": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "IP6": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:{_HEX}(?::{_HEX}){{7}}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z:])",
    "NAME": rf"(?<!\p{{L}})(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.?[ ]{_NAME_WORD}(?:[ ]{_NAME_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity; the test is far cheaper than the patterns.
HINT = rf"[0-9@=:]|AKIA|(?<!\p{{L}})(?=[MHSFDPГ])(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.?[ ]\p{{Lu}}"
#: Scripts whose letters are kept: surrogate letters come from the alphabet of the letter they replace; letters and marks
#: of other scripts become Latin ones.
ALPHABETS = {
    "Latin": ("abcdefghijklmnopqrstuvwxyz", r"\p{IsLatin}"),
    "Cyrillic": ("абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsCyrillic}"),
    "Greek": ("αβγδεζηθικλμνξοπρστυφχψω", r"\p{IsGreek}"),
    "Han": ("安白北本长成大东方风高光海和花江金京林明南平青山水天文西新云", r"\p{IsHan}"),
    "Hiragana": ("あいうえおかきくけこさしすせそたちつてとなにのはひまみやゆらりる", r"\p{IsHiragana}"),
    "Katakana": ("アイウエオカキクケコサシスセソタチツテトナニノハヒマミヤユラリル", r"\p{IsKatakana}"),
    "Hangul": ("가나다라마바사아자차카타파하고노도로모보소오조구누두루무부수우주", r"\p{IsHangul}"),
    "Arabic": ("ابتثجحدرزسشصطعغفقكلمنهوي", r"\p{IsArabic}"),
    "Hebrew": ("אבגדהוזחטיכלמנסעפצקרשת", r"\p{IsHebrew}"),
}
#: From this draw on a value may leave its form: too few others of the same form are free.
WIDER = 2
#: Draws after which the ledger gives up; every draw halves the conflicts at least, unless a form is used up.
MOST_DRAWS = 64
_SYLLABLES = {
    "Latin": ("ba be bi bo da de di do fa fe ga go ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti va ve", "o a en"),
    "Cyrillic": ("ба бе би бо да де ди до за зе ка ке ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си та те ти ва ве", "ин ина ен"),
    "Greek": ("βα βε βι βο δα δε δι δο ζα ζε κα κε κι λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι τα τε τι φα φε", "ος α ην"),
}


def hinted(text: Column) -> Column:
    """Whether a text may have an entity; not for null."""
    return F.coalesce(text.rlike(HINT), F.lit(False))


def entities(text: Column) -> Column:
    """Matches of any pattern, left to right."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check; a number is valid if it is divisible by 10."""
    reverse = F.split(F.reverse(digits), "")
    doubled = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    values = F.transform(reverse, lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(doubled(c.try_cast("int"))))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))


def mod97(text: Column) -> Column:
    """Remainder by 97 of an account number, letters counting as 10 to 35."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))


def _account(entity: Column) -> Column:
    return F.translate(entity, " ", "")


def _turned(account: Column) -> Column:
    """The form of an account number that its check is taken of: country and check digits last."""
    return F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))


def kind_of(entity: Column) -> Column:
    """Type of a match; null for what has the form of a card or account number but fails its check, and stays as it is."""
    choice = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        fits = entity.rlike(f"^(?:{pattern})$")
        if kind == "CARD":
            fits = fits & (luhn_sum(_digits(entity)) % 10 == 0)
        elif kind == "IBAN":
            fits = fits & (mod97(_turned(_account(entity))) == 1)
        choice = F.when(fits, F.lit(kind)).otherwise(choice)
    return choice


def atoms_of(entity: Column, kind: Column) -> Column:
    """The parts of an entity that get a surrogate of their own, as (atom type, canonical value).

    Spelling does not matter: mail addresses are lower-cased and numbers stripped of punctuation but the + of a country code. Words of a name are parts,
    so that "Mr. Ann Lee" and "Mr. Lee" keep their surname; the first of several words is a given name of the title's gender.
    """
    title = F.regexp_extract(entity, r"^(\S+) ", 1)
    gender = F.when(title.rlike(rf"^{_MALE}\.?$"), "M").when(title.rlike(rf"^{_FEMALE}\.?$"), "F").otherwise("N")
    words = F.slice(F.split(entity, " "), 2, 10)
    of_name = F.transform(words, lambda w, i: F.struct(F.when((i == 0) & (F.size(words) > 1), F.concat(F.lit("GIVEN_"), gender)).otherwise("SURNAME").alias("kind"), F.lower(w).alias("canon")))
    canon = F.when(kind == "EMAIL", F.lower(entity)).when(kind == "PHONE", F.regexp_replace(entity, "[^0-9+]", "")).when(kind.isin("CARD", "SSN"), _digits(entity)).when(kind == "SECRET", _secret(entity)).when(kind == "IBAN", _account(entity)).when(kind == "IP6", F.lower(entity)).otherwise(entity)
    return F.when(kind == "NAME", of_name).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def _secret(entity: Column) -> Column:
    return F.regexp_extract(entity, r"([A-Za-z0-9+/_-]{8,})$", 1)


def _hash(key: str, *parts: Column | str) -> Column:
    """256 keyed bits as 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def _byte(seed: Column, i: Column, at_most: int | Column) -> Column:
    """A number below ``at_most`` from a keyed seed for place ``i``; places are drawn independently."""
    return F.pmod(F.xxhash64(seed, i), F.lit(at_most) if isinstance(at_most, int) else at_most).cast("int")


def _filled(value: Column, seed: Column, hexadecimal: Column | None = None) -> Column:
    """``value`` with digits for digits and letters for letters of the same case and, where known, script; punctuation stays."""

    def one(c: Column, i: Column) -> Column:
        among = F.when(c.rlike(r"^\p{N}$"), F.lit("0123456789"))
        if hexadecimal is not None:
            among = among.when(hexadecimal & c.rlike("^[a-fA-F]$"), F.lit("abcdef"))
        for alphabet, pattern in [*ALPHABETS.values(), (ALPHABETS["Latin"][0], r"[\p{L}\p{M}]")]:
            among = among.when(c.rlike(f"^{pattern}$"), F.lit(alphabet))
        drawn = F.transform(F.array(among), lambda a: F.substring(a, _byte(seed, i, F.length(a)) + 1, F.lit(1)))
        return F.element_at(F.transform(drawn, lambda d: F.when(d.isNull(), c).when(c == F.lower(c), d).otherwise(F.upper(d))), 1)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _name(canon: Column, seed: Column, attempt: Column, ending: int) -> Column:
    """A made-up name in the script of ``canon``: syllables and, for a given name, an ending of the gender."""

    def built(script: str) -> Column:
        syllables, endings = (F.array(*[F.lit(s) for s in part.split()]) for part in _SYLLABLES[script])
        count = len(_SYLLABLES[script][0].split())
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + attempt), lambda i: F.element_at(syllables, _byte(seed, i * 2, count) + 1)), "")
        return F.concat(stem, F.element_at(endings, F.lit(ending)))

    out = built("Latin")
    for script in ("Cyrillic", "Greek"):
        out = F.when(canon.rlike(ALPHABETS[script][1]), built(script)).otherwise(out)
    return out


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Surrogate of an atom in its canonical form; another one for every ``attempt``.

    From attempt WIDER on, mail addresses and secrets end in ever more hashed characters, so that values with few or no
    letters and digits find one, and private networks move to the largest one.
    """
    seed = _hash(key, kind, canon, attempt)
    wide = attempt >= WIDER
    tail = F.when(wide, F.substring(seed, F.lit(1), attempt + 2)).otherwise("")
    numbers = _filled(canon, seed)
    payload = F.concat(F.substring(canon, F.lit(1), F.lit(1)), F.substring(numbers, F.lit(2), F.length(canon) - 2))
    card = F.concat(payload, F.pmod(-luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string"))
    phone_code = F.length(F.regexp_extract(canon, rf"^(?:{_COUNTRY}|0)?", 0))
    phone = F.concat(F.substring(canon, F.lit(1), phone_code), F.substring(numbers, phone_code + 1, F.length(canon)))
    octets = F.split(canon, r"\.")
    private = canon.rlike(r"^(?:10|127|192\.168)\.")
    octet = lambda i: (_byte(seed, F.lit(i * 4), 254) + 1).cast("string")
    moved = F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))
    ip = F.when(private & wide, moved).otherwise(F.array_join(F.transform(octets, lambda o, i: F.when(private & (i < F.when(canon.startswith("192"), 2).otherwise(1)), o).otherwise((_byte(seed, i * 4, 254) + 1).cast("string"))), "."))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host, suffix = F.regexp_extract(domain, r"^(.*)\.", 1), F.substring_index(domain, ".", -1)
    mail = F.concat(_filled(local, seed), tail, F.lit("@"), _filled(host, _hash(key, "DOMAIN", domain)), F.lit("."), suffix)
    secret = F.concat(_filled(canon, seed, canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), tail)
    groups = F.concat(F.lit("fd00::"), F.substring(seed, F.lit(1), F.lit(4)), F.lit(":"), F.substring(seed, F.lit(5), F.lit(4)))
    ip6 = F.when(wide & canon.contains("::"), groups).otherwise(_filled(canon, seed, F.lit(True)))
    body = F.concat(F.substring(canon, F.lit(1), F.lit(2)), F.lit("00"), F.upper(F.substring(numbers, F.lit(5), F.length(canon))))
    check = F.lpad((F.lit(98) - mod97(_turned(body))).cast("string"), 2, "0")
    iban = F.concat(F.substring(body, F.lit(1), F.lit(2)), check, F.substring(body, F.lit(5), F.length(body)))
    aws = F.concat(F.lit("AKIA"), _filled(F.substring(canon, F.lit(5), F.lit(16)), seed))
    return (
        F.when(kind == "EMAIL", mail)
        .when(kind == "SECRET", secret)
        .when(kind == "KEY", aws)
        .when(kind == "CARD", card)
        .when(kind == "PHONE", phone)
        .when(kind == "IP", ip)
        .when(kind == "IP6", ip6)
        .when(kind == "IBAN", iban)
        .when(kind == "SSN", numbers)
        .when(kind == "GIVEN_M", _name(canon, seed, attempt, 1))
        .when(kind == "GIVEN_F", _name(canon, seed, attempt, 2))
        .when(kind == "GIVEN_N", _name(canon, seed, attempt, 3))
        .when(kind == "SURNAME", _name(canon, seed, attempt, 3))
    )


def ledger(atoms: DataFrame, key: str) -> DataFrame:
    """``(kind, canon, replacement)`` for the distinct ``atoms(kind, canon)``, one replacement to one value.

    While two values of a type share a replacement, or a replacement is itself a value found in the corpus, all but the
    smallest of them draw again. Only those in conflict are drawn anew, so rounds get smaller fast; a corpus that uses up
    a form (such as most numbers of nine digits) is an error after MOST_DRAWS draws.
    """
    replacement = surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)
    drawn = lambda df: df.withColumn("replacement", replacement)
    current = cut(drawn(atoms.distinct().withColumn("attempt", F.lit(0))))
    originals = current.select("kind", F.col("canon").alias("replacement"))
    for _ in range(MOST_DRAWS):
        shared = current.groupBy("kind", "replacement").agg(F.count("*").alias("n"), F.min("canon").alias("owner")).where("n > 1").drop("n")
        twice = current.join(shared, ["kind", "replacement"]).where("canon <> owner").select("kind", "canon")
        taken = current.join(originals, ["kind", "replacement"], "left_semi").select("kind", "canon")
        losers = cut(twice.unionByName(taken).distinct())
        if losers.isEmpty():
            return current.select("kind", "canon", "replacement")
        again = current.join(losers, ["kind", "canon"], "left_semi").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        current = cut(current.join(losers, ["kind", "canon"], "left_anti").unionByName(drawn(again)))
    raise RuntimeError(f"no free replacements after {MOST_DRAWS} draws")


def _dressed(entity: Column, kind: Column, new: Column) -> Column:
    """The surrogates ``new`` of an entity's atoms in the spelling of the entity."""
    first = F.get(new, F.lit(0))
    digits = _digits(first)
    chars = F.split(entity, "")
    before = lambda i: F.length(_digits(F.substring(entity, F.lit(1), i + 1)))
    numbers = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, before(i), F.lit(1))).otherwise(c)), "")
    account = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(first, F.length(_account(F.substring(entity, F.lit(1), i + 1))), F.lit(1)))), "")
    mail = F.when((entity == F.upper(entity)) & (entity != F.lower(entity)), F.upper(first)).otherwise(first)
    head = F.substring(entity, F.lit(1), F.length(entity) - F.length(_secret(entity)))
    name = F.concat_ws(" ", F.regexp_extract(entity, r"^(\S+) ", 1), F.array_join(F.transform(new, F.initcap), " "))
    return F.when(kind == "NAME", name).when(kind == "EMAIL", mail).when(kind == "SECRET", F.concat(head, first)).when(kind.isin("CARD", "PHONE", "SSN"), numbers).when(kind == "IBAN", account).when((kind == "IP6") & (entity == F.upper(entity)), F.upper(first)).otherwise(first)


def replacements(found: DataFrame, key: str) -> DataFrame:
    """``(entity, kind, replacement, names)`` for the distinct ``found(entity)`` that are personal data.

    ``names`` has the words of a name after its title, in lower case, each with its replacement and whether it is the last.
    """
    typed = cut(found.distinct().withColumn("kind", kind_of(F.col("entity"))).where("kind IS NOT NULL"))
    parts = typed.select("entity", "kind", F.posexplode(atoms_of(F.col("entity"), F.col("kind"))).alias("i", "atom"))
    parts = parts.select("entity", F.col("kind").alias("type"), "i", "atom.kind", "atom.canon")
    known = ledger(parts.select("kind", "canon"), key)
    each = F.struct("i", "replacement", "canon")
    gathered = parts.join(known, ["kind", "canon"]).groupBy("entity", "type").agg(F.sort_array(F.collect_list(each)).alias("new"))
    words = F.transform("new", lambda x, i: F.struct(x["canon"].alias("word"), x["replacement"].alias("new"), (i == F.size("new") - 1).alias("last")))
    return gathered.select(
        "entity",
        F.col("type").alias("kind"),
        _dressed(F.col("entity"), F.col("type"), F.transform("new", lambda x: x["replacement"])).alias("replacement"),
        F.when(F.col("type") == "NAME", words).otherwise(F.slice(words, 1, 0)).alias("names"),
    )


def _bare(names: Column) -> Column:
    """Pattern of later mentions, in the same text, of people named after a title: given names with a surname, or it alone."""
    given = F.array_join(F.transform(F.filter(names, lambda x: ~x["last"]), lambda x: x["word"]), "|")
    last = F.array_join(F.transform(F.filter(names, lambda x: x["last"]), lambda x: x["word"]), "|")
    capital = r"(?=\p{Lu})(?iu:"
    before = F.when(given != "", F.concat(F.lit(f"(?:{capital}"), given, F.lit(r")[ ]){0,2}"))).otherwise("")
    return F.concat(F.lit(r"(?<!\p{L})"), before, F.lit(capital), last, F.lit(r")(?!['’-]?\p{L}(?<!['’]s(?!\p{L})))"))


def _renamed(mention: Column, names: Column) -> Column:
    """A bare mention with the replacements of its words, the last being a surname."""
    words = F.split(mention, " ")

    def one(w: Column, i: Column) -> Column:
        fits = F.filter(names, lambda x: (x["word"] == F.lower(w)) & (x["last"] == (i == F.size(words) - 1)))
        return F.initcap(F.get(fits, F.lit(0))["new"])

    return F.array_join(F.transform(words, one), " ")


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and a column n_entities.

    Found are mail addresses, secrets after a label, access keys, card and account numbers (by their check digits), phone
    numbers, social security numbers, IPv4 and IPv6 addresses, names after a title and, later or earlier in the same text,
    the same surname without one, with or without the given names. A replacement depends on ``key``, which must be kept
    secret, on type and on value alone, but for rare redraws: the same value gets the same one in all documents whatever
    its spelling, different values get different ones, and none is a value that the corpus has. Digits, letters, case,
    script, punctuation, check digits, the first digit of a card, country codes, a trunk 0, private networks, top-level
    domains, titles and gender are kept. The text between entities is untouched. Null texts stay null; repeated rows stay
    alike; ids may be null or repeat; other columns pass through, but a column n_entities of ``docs`` is replaced; an empty
    table gives an empty result.
    """
    if not key:
        raise ValueError("a secret key is needed")
    kept = [c for c in docs.columns if c.lower() != "n_entities"]
    names = [f"`{c}`" for c in kept if c != "text"]
    whole = docs.select(F.struct(*names).alias("own") if names else F.struct(F.lit(0)).alias("own"), "text")
    key_of = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.length("text"))
    suspect = whole.where(hinted(F.col("text"))).select("own", "text", key_of.alias("k"))
    # The patterns run once; copies of a text share its entities.
    found = cut(suspect.select("k", F.posexplode(entities(F.col("text"))).alias("i", "entity")).distinct())
    known = cut(replacements(found.select("entity"), key))  # both sides of the join are dealt anew, so a hot value can be split
    swapped = found.join(known, "entity", "left").select("k", "names", F.struct("i", F.coalesce("replacement", "entity").alias("new"), F.col("kind").isNotNull().alias("swapped")).alias("s"))
    people = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names"))))
    per_text = cut(swapped.groupBy("k").agg(F.sort_array(F.collect_list("s")).alias("s"), people.alias("people")))
    dirty = suspect.join(per_text, "k", "left").select("own", "text", "s", "people", F.when(F.size("people") > 0, _bare(F.col("people"))).alias("bare"))
    pieces = F.split("text", ANY, -1)
    mentions = lambda p: F.regexp_extract_all(p, F.col("bare"), F.lit(0))
    rename = lambda p: F.array_join(F.zip_with(F.split(p, F.col("bare"), F.lit(-1)), mentions(p), lambda a, m: F.concat(a, F.coalesce(_renamed(m, F.col("people")), F.lit("")))), "")
    joined = lambda each: F.array_join(F.zip_with(each, "s", lambda p, e: F.concat(p, F.coalesce(e["new"], F.lit("")))), "")
    named = F.col("bare").isNotNull()
    text = F.when(F.col("s").isNull(), F.col("text")).when(named, joined(F.transform(pieces, rename))).otherwise(joined(pieces))
    bare = F.when(named, F.aggregate(F.transform(pieces, lambda p: F.size(mentions(p))), F.lit(0), lambda a, n: a + n)).otherwise(0)
    count = F.when(F.col("s").isNull(), 0).otherwise(F.size(F.filter("s", lambda e: e["swapped"])) + bare)
    clean = whole.where(~hinted(F.col("text"))).select("own", "text", F.lit(0).alias("n_entities"))
    return clean.unionByName(dirty.select("own", text.alias("text"), count.alias("n_entities"))).select(*[f"own.`{c}`" if c != "text" else "text" for c in kept], "n_entities")
