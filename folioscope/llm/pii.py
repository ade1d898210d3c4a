"""Personal data replaced by keyed surrogates, in DataFrame functions only.

One regular expression finds the entities of a text. A surrogate is a function of
a key, the entity's kind and its normal form, so an entity gets the same one
wherever it occurs (an address in other case, a card with other spacing). It has
the entity's format: letters stay letters of their case, digits digits, marks
stay; a card passes the Luhn test as the original did; a name keeps its title. Surname
and given names are entities of their own, from which sole and full names are
built: a made-up surname, and a given name from a list of the same gender and
script. So that different entities stay different, all distinct entities of the
corpus are collected, those whose surrogate another one has too (or that is itself
an entity found) try the next number, and the few that needed it are joined back to
their documents.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written

#: Session setting with the key, where a call names none.
KEY_SETTING = "folioscope.pii.key"
#: Characters of a secret that get surrogates of their own.
LONG = 256
#: Documents with a renumbered entity up to which the list goes to every executor.
BROADCAST_ROWS = 50_000

# Titles and given names by gender and script: (male, female).
TITLES = (
    ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "Господин", "Κύριος"],
    ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа", "Госпожа", "Κυρία"],
)
NEUTRAL = ["Dr", "Prof"]
GIVEN = {
    "latin": (
        ["James", "John", "Robert", "Michael", "David", "Thomas", "Peter", "Hans", "Karl", "Pierre", "Jean", "Luis", "Carlos", "Juan", "Paul", "Martin",
         "Wei", "Ahmed", "Omar", "Raj", "Hiroshi", "Marco", "Andrei", "William", "George", "Daniel"],
        ["Mary", "Anna", "Linda", "Susan", "Laura", "Emma", "Julia", "Maria", "Sophie", "Claire", "Marie", "Carmen", "Elena", "Greta", "Helga", "Nina",
         "Mei", "Fatima", "Aisha", "Priya", "Yuki", "Chiara", "Ingrid", "Elizabeth", "Patricia", "Sarah"],
    ),
    "cyrillic": (
        ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"],
        ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Татьяна", "Ирина", "Светлана"],
    ),
    "greek": (
        ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Πέτρος", "Παύλος", "Ανδρέας"],
        ["Μαρία", "Ελένη", "Άννα", "Σοφία", "Κατερίνα", "Ειρήνη", "Δήμητρα", "Βασιλική"],
    ),
}
SYLLABLES = {
    "latin": ["ba", "den", "fi", "gor", "hal", "ki", "lum", "mer", "no", "pel", "ris", "sto", "tan", "vel", "wen", "zor"],
    "cyrillic": ["ба", "ден", "фи", "гор", "хал", "ки", "лум", "мер", "но", "пел", "рис", "сто", "тан", "вел", "вен", "зор"],
    "greek": ["βα", "δεν", "φι", "γορ", "χαλ", "κι", "λουμ", "μερ", "νο", "πελ", "ρισ", "στο", "ταν", "βελ", "γεν", "ζορ"],
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = rf"(?:{'|'.join(sum(TITLES, []) + NEUTRAL)})\.?"
_GIVEN = rf"(?:{'|'.join(n for pair in GIVEN.values() for names in pair for n in names)})"
_PARTICLES = r"(?:(?:de|del|della|di|da|dos|du|la|las|los|le|van|von|der|den|ten|el|al|bin|ibn) )"
#: A capital with letters of any case, an apostrophe after the first one.
_CAP = r"(?:\p{Lu}['’](?=\p{Lu}))?\p{Lu}\p{L}+"
_SURNAME = rf"{_PARTICLES}{{0,3}}{_CAP}(?:-{_CAP}){{0,2}}"
_LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"']? {0,2}[=:] {0,2}"
#: A quoted value ends at its quote, any other at white space, a quote, a comma or
#: a semicolon, without marks that end a sentence.
_SECRET_VALUE = r"(?:\"[^\"\n]{8,}(?=\")|'[^'\n]{8,}(?=')|[\"']?[^\s\"',;<>]{7,}[^\s\"',;<>.!?:()\[\]{}])"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}"
ACCESS_KEY = r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
SECRET = _LABEL + _SECRET_VALUE
IP = rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![\d.]*\d)"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
# 4-4-4-4 with or without a last group of three, 4-6-5, 4-6-4, 4-4-5; then any groups, which need a Luhn sum
_PLAIN_CARD = (
    r"\d{13,19}(?!\d)|\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{3}(?![ -]?\d)|\d{4}(?:[ -]\d{4}){3}(?!\d)"
    r"|\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)"
).replace("([ -])", "(?<mark>[ -])").replace("\\1", r"\k<mark>")
_GROUPED = r"(?!(?:\d+[ -]){1,6}(?:\d{13,19}(?!\d)|\d{4}(?:[ -]\d{4}){3}(?!\d)|\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)))" \
    r"(?=(?:\d[ -]?){12,18}\d(?![ -]?\d))\d{2,7}(?:[ -]\d{1,13}){1,8}"
CARD = f"{_PLAIN_CARD}|{_GROUPED}"
SOCIAL = r"\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)|[2-9]\d{2} \d{3} \d{4}(?![ -]?\d)|[2-9]\d{9}(?!\d)"
NAME = rf"{_TITLE} (?:{_CAP}[ -]){{0,2}}{_SURNAME}|{_GIVEN} (?:{_CAP} )?{_SURNAME}"
# each part is tried only where its first character can stand
ENTITY = (
    rf"(?=[A-Za-z0-9._%+\-\p{{Lu}}г])(?<![\p{{L}}\p{{N}}._%+-])(?:{EMAIL}|(?=[A-Z])(?:{ACCESS_KEY}|{IBAN})"
    rf"|(?=[\p{{Lu}}г])(?:{NAME})|(?=[0-9])(?:{IP}|{SOCIAL}))"
    rf"|(?=[PpSsTtAa])(?<![\p{{L}}\p{{N}}]){SECRET}"
    rf"|(?=[0-9+(])(?<![\p{{L}}\p{{N}}.])(?:{PHONE}|{CARD})"
)
#: A text without this has no entity.
HINT = rf"[0-9@=:]|AKIA|(?=[\p{{Lu}}г])(?<!\p{{L}})(?:{NAME})"
KINDS = ("email", "key", "secret", "iban", "name", "ip", "social", "card", "phone")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def kind_of(x: Column) -> Column:
    """Null for groups of digits that are no card by their Luhn sum."""
    whole = lambda p: x.rlike(f"^(?:{p})$")
    return (
        F.when(x.rlike(f"^{_LABEL}"), "secret").when(x.contains("@"), "email").when(whole(ACCESS_KEY), "key")
        .when(whole(NAME), "name").when(whole(IBAN), "iban").when(whole(IP), "ip").when(whole(SOCIAL), "social")
        .when(whole(PHONE), "phone").when(whole(_PLAIN_CARD) | (_luhn(_digits(x)) == 0), "card")
    )


def _value(x: Column) -> Column:
    """The part of a secret after its label."""
    return F.regexp_replace(x, rf"^{_LABEL}[\"']?", "")


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{_TITLE} ", "")


def normal(kind: Column, x: Column) -> Column:
    """What two mentions of one entity have in common."""
    return (
        F.when(kind == "email", F.lower(x)).when(kind == "secret", _value(x))
        .when(kind.isin("card", "phone", "social"), _digits(x)).when(kind == "iban", F.regexp_replace(x, " ", ""))
        .when(kind == "name", F.lower(_bare(x))).when(kind.isin("surname", "given"), F.lower(x)).otherwise(x)
    )


def _stream(key: str, *of: Column) -> Column:
    """64 bytes in hex that depend on the key and the values."""
    first = F.sha2(F.concat_ws("\u0001", F.lit(key), *of), 256)
    return F.concat(first, F.sha2(F.concat(F.lit(key), first), 256))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(x: Column, stream: Column, small: str = string.ascii_lowercase) -> Column:
    """Letters and digits of ``x`` replaced by ones of the same class, counted
    without the marks between them so that spacing doesn't matter."""

    def one(c: Column, i: Column) -> Column:
        byte = _byte(stream, F.length(F.regexp_replace(F.substring(x, F.lit(1), i), "[^A-Za-z0-9]", "")))
        pick = lambda chars: F.substring(F.lit(chars), byte % len(chars) + 1, F.lit(1))
        return (
            F.when(c.rlike("[a-z]"), pick(small)).when(c.rlike("[A-Z]"), pick(string.ascii_uppercase))
            .when(c.rlike("[0-9]"), pick(string.digits)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(x, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _card(x: Column, stream: Column) -> Column:
    """The first digit stays; the last one makes the Luhn sum what it was."""

    def finish(y: Column) -> Column:
        last = F.right(y, F.lit(1)).cast("int")
        want = (last + _luhn(_digits(x)) - _luhn(_digits(y)) + 20) % 10
        return F.concat(F.substring(y, F.lit(1), F.length(y) - 1), want.cast("string"))

    return _let(F.concat(F.left(x, F.lit(1)), F.substring(_shaped(x, stream), F.lit(2), F.length(x))), finish)


def _phone(x: Column, stream: Column) -> Column:
    """The country code stays; the digit after it is 2 or more."""
    code = F.regexp_extract(x, r"^\+\d{1,3}(?=[ .(-])", 0)

    def finish(y: Column) -> Column:
        rest = F.substring(y, F.length(code) + 1, F.length(y))
        return F.concat(code, F.regexp_replace(rest, r"^([^0-9]*)[01]", "$17"))

    return _let(_shaped(x, stream), finish)


def _ip(x: Column, stream: Column, attempt: Column) -> Column:
    """Private networks keep their prefix, others stay public; late attempts of the
    small private network take the large one."""
    o = [_byte(stream, F.lit(k)) for k in range(4)]
    dots = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    first = F.lit(11) + o[0] % 111
    return (
        F.when(x.rlike(r"^10\."), dots(F.lit(10), *o[1:])).when(x.rlike(r"^192\.168\.") & (attempt >= 4), dots(F.lit(10), *o[1:]))
        .when(x.rlike(r"^192\.168\."), dots(F.lit(192), F.lit(168), *o[2:]))
        .when(x.rlike(r"^127\."), dots(F.lit(127), *o[1:])).otherwise(dots(first, *o[1:]))
    )


def _lists(names: dict[str, list[str]], which: Column) -> Column:
    """The list of ``names`` under the key ``which``."""
    out = F.array().cast("array<string>")
    for name, items in names.items():
        out = F.when(which == name, F.array(*map(F.lit, items))).otherwise(out)
    return out


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name_parts(x: Column) -> Column:
    """``title, surname, given, pool`` of a name; the pool is script and gender, by
    title, else by the given name, else by a hash of it."""
    men, women = ([n for pair in GIVEN.values() for n in pair[k]] for k in (0, 1))

    def cut(n: Column) -> Column:
        surname = F.regexp_extract(n["bare"], rf"(?<![^ ]){_PARTICLES}*[^ ]+$", 0)
        given = F.trim(F.substring(n["bare"], F.lit(1), F.length(n["bare"]) - F.length(surname)))
        return F.struct(n["title"].alias("title"), surname.alias("surname"), given.alias("given"))

    def judge(n: Column) -> Column:
        label, first = F.regexp_replace(n["title"], r"\.", ""), F.initcap(F.regexp_extract(n["given"], "^[^ -]*", 0))
        guess = F.crc32(F.lower(n["given"])) % 2 == 0
        female = label.isin(TITLES[1]) | (~label.isin(TITLES[0]) & (first.isin(women) | (~first.isin(men) & guess)))
        pool = F.concat(_script(F.concat(n["given"], n["surname"])), F.when(female, "1").otherwise("0"))
        return F.struct(n["title"].alias("title"), n["surname"].alias("surname"), n["given"].alias("given"), pool.alias("pool"))

    whole = F.struct(F.regexp_extract(x, rf"^{_TITLE}(?= )", 0).alias("title"), _bare(x).alias("bare"))
    return _let(_let(whole, cut), judge)


def _given_norm(n: Column) -> Column:
    return F.concat(n["pool"], F.lit(":"), F.lower(n["given"]))


def _made(script: Column, stream: Column, first: int, count: Column) -> Column:
    """A word of ``count`` syllables, the first letter a capital."""
    return _let(_lists(SYLLABLES, script), lambda parts: F.initcap(F.array_join(
        F.transform(F.sequence(F.lit(1), count), lambda k: F.get(parts, _byte(stream, k + first) % 16)), ""
    )))


def _surname(x: Column, stream: Column, attempt: Column) -> Column:
    """Particles, ``O'`` and a hyphen stay; each attempt has a syllable more."""
    kept = F.regexp_extract(x, rf"^(?i:{_PARTICLES}*(?:\p{{L}}['’])?)", 0)
    count = F.lit(5) + F.least(attempt, F.lit(20))
    second = F.when(x.contains("-"), F.concat(F.lit("-"), _made(_script(x), stream, 40, F.lit(3)))).otherwise("")
    made = F.concat(_made(_script(x), stream, 0, count), second)
    return F.concat(kept, F.when((x == F.upper(x)) & (x != F.lower(x)), F.upper(made)).otherwise(made))


def _given(norm: Column, stream: Column, attempt: Column) -> Column:
    """Of a list by gender and script; later attempts add a made-up second name."""
    pools = {f"{script}{k}": pair[k] for script, pair in GIVEN.items() for k in (0, 1)}
    pool = F.regexp_extract(norm, "^[a-z]+[01]", 0)
    first = _let(_lists(pools, pool), lambda names: F.get(names, (_byte(stream, F.lit(0)) * 256 + _byte(stream, F.lit(1))) % F.size(names)))
    more = F.concat(F.lit("-"), _made(F.regexp_replace(pool, "[01]", ""), stream, 1, F.lit(2) + F.least(attempt, F.lit(20))))
    return F.concat(first, F.when(attempt > 0, more).otherwise(""))


def _email(x: Column, key: str, stream: Column, attempt: Column) -> Column:
    """Short addresses run out, so late attempts add their number."""
    label = _shaped(F.lit("aaaaaa"), _stream(key, F.lit("domain"), F.lower(F.substring_index(x, "@", -1))))
    more = F.when(attempt >= 4, attempt.cast("string")).otherwise("")
    return F.concat(_shaped(F.substring_index(x, "@", 1), stream), more, F.lit("@"), label, F.lit(".example.com"))


def _secret(x: Column, stream: Column) -> Column:
    """The label stays, and a value in hex stays one. What a value has beyond LONG
    characters repeats the first ones' surrogate."""

    def put(value: Column) -> Column:
        start = F.left(value, F.lit(LONG))
        new = F.when(value.rlike("^[0-9a-f]+$"), _shaped(start, stream, "abcdef")).otherwise(_shaped(start, stream))
        new = F.rpad(new, F.length(value), new)
        return F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(value)), new)

    return _let(_value(x), put)


def surrogate(e: Column, key: str, attempt: Column) -> Column:
    """Of the struct ``e`` of ``kind, norm, x``, where names come in parts. What
    several others need is bound once, which keeps the expression small."""

    def put(s: Column) -> Column:
        kind, x, stream, attempt = s["kind"], s["x"], s["stream"], s["attempt"]
        return (
            F.when(kind == "email", _email(x, key, stream, attempt))
            .when(kind == "key", F.concat(F.lit("AKIA"), F.substring(_shaped(x, stream), 5, 16)))
            .when(kind == "secret", _secret(x, stream))
            .when(kind == "iban", F.concat(F.left(x, F.lit(2)), F.substring(_shaped(x, stream), F.lit(3), F.length(x))))
            .when(kind == "surname", _surname(x, stream, attempt)).when(kind == "given", _given(x, stream, attempt))
            .when(kind == "ip", _ip(x, stream, attempt))
            .when(kind == "card", _card(x, stream)).when(kind == "phone", _phone(x, stream))
            .otherwise(_shaped(x, stream))
        )

    stream = _stream(key, e["kind"], e["norm"], attempt.cast("string"))
    return _let(F.struct(e["kind"].alias("kind"), e["x"].alias("x"), attempt.alias("attempt"), stream.alias("stream")), put)


def _part(kind: str, norm: Column, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), norm.alias("norm"), x.alias("x"))


def replacement(e: Column, key: str, attempt) -> Column:
    """The surrogate of an entity; ``attempt`` gives the number by kind and norm."""

    def put(part: Column) -> Column:
        return surrogate(part, key, attempt(part["kind"], part["norm"]))

    def name(n: Column) -> Column:
        given = F.when(n["given"] != "", _let(_part("given", _given_norm(n), _given_norm(n)), put))
        return F.concat_ws(" ", F.when(n["title"] != "", n["title"]), given, _let(_part("surname", F.lower(n["surname"]), n["surname"]), put))

    return F.when(e["kind"] == "name", _let(_name_parts(e["x"]), name)).otherwise(put(e))


def _numbered(e: Column) -> Column:
    """``kind, norm`` of what has a number of its own in an entity."""
    pair = lambda kind, norm: F.struct(kind.alias("kind"), norm.alias("norm"))
    parts = _let(_name_parts(e["x"]), lambda n: F.when(
        n["given"] == "", F.array(pair(F.lit("surname"), F.lower(n["surname"])))
    ).otherwise(F.array(pair(F.lit("surname"), F.lower(n["surname"])), pair(F.lit("given"), _given_norm(n)))))
    return F.when(e["kind"] == "name", parts).otherwise(F.array(pair(e["kind"], e["norm"])))


def _entities(found: Column) -> Column:
    """``kind, norm, x`` of each string found."""
    kinds = F.transform(found, lambda x: F.struct(kind_of(x).alias("kind"), x.alias("x")))
    return F.transform(kinds, lambda e: F.struct(e["kind"].alias("kind"), normal(e["kind"], e["x"]).alias("norm"), e["x"].alias("x")))


def _found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def renumbered(entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, attempt`` of the entities whose first surrogate is another's
    too, or is an entity itself, and the number at which theirs is their own. A
    given name may be another's; where a small space is full of entities, later
    attempts may meet one too, but never another's surrogate.

    ``entities`` has distinct ``kind, norm``. Each round is written; only the
    entities still in conflict get a new number, so the rounds end."""
    state = entities.select("kind", "norm", F.lit(0).alias("attempt"))
    while True:
        entity = F.struct("kind", "norm", F.col("norm").alias("x"))
        put = _let(surrogate(entity, key, F.col("attempt")), lambda x: normal(F.col("kind"), x))
        state = written(state.withColumn("put", put), "surrogates")
        first = state.groupBy("kind", "put").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count("*").alias("n"))
        twice = first.where("n > 1").select("kind", "put", "first.norm").withColumnRenamed("norm", "owner")
        shared = state.join(twice, ["kind", "put"]).where("norm <> owner").select("kind", "norm")
        real = entities.where("kind <> 'given'").select("kind", F.col("norm").alias("put"))
        conflict = written(shared.union(state.where("attempt < 8").join(real, ["kind", "put"], "left_semi").select("kind", "norm")).distinct(), "conflicts")
        if conflict.isEmpty():
            return state.where("attempt > 0").select("kind", "norm", "attempt")
        again = conflict.withColumn("more", F.lit(1))
        state = state.join(again, ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))


def _key(docs: DataFrame, key: str | None) -> str:
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"surrogates need a key: an argument or the setting {KEY_SETTING}")
    return key


def replace_pii(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced, and ``pii_kinds``, the
    kinds found in order (replacing a column of that name).

    Every row is treated alone but for the numbers of renumbered entities, so
    null ids and repeated rows make no difference; a null text stays null with no
    kinds. Rows without entities keep their text byte for byte. Other columns may
    have any name. Without a ``key`` the session's is taken; none is an error.
    """
    key = _key(docs, key)
    columns = [c for c in docs.columns if c != "pii_kinds"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    text, mark = F.col("text"), F.xxhash64("text")
    mentions = rows.select(_found(text).alias("f"), mark.alias("mark")).where(F.size("f") > 0)
    mentions = mentions.select("mark", F.explode(_entities(F.col("f"))).alias("e")).where("e.kind IS NOT NULL")
    mentions = written(mentions.select("mark", F.explode(_numbered(F.col("e"))).alias("e")).select("mark", "e.kind", "e.norm").distinct(), "mentions")
    numbers = written(renumbered(mentions.select("kind", "norm").distinct(), key), "numbers")
    found = rows.withColumn("found", F.coalesce(_entities(_found(text)), F.array().cast("array<struct<kind:string,norm:string,x:string>>")))
    attempt = lambda kind, norm: F.lit(0)
    if not numbers.isEmpty():
        per_text = mentions.join(numbers, ["kind", "norm"]).groupBy("mark").agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "norm"), "attempt"))).alias("numbers")
        )
        small = per_text.count() <= BROADCAST_ROWS
        found = found.withColumn("mark", mark).join(F.broadcast(per_text) if small else per_text, "mark", "left")
        attempt = lambda kind, norm: F.coalesce(F.element_at("numbers", F.concat_ws("\u0001", kind, norm)), F.lit(0))
    put = F.transform("found", lambda e: F.when(e["kind"].isNull(), e["x"]).otherwise(replacement(e, key, attempt)))
    gaps = F.split(text, ENTITY, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("found")), put, lambda g, p: F.concat(g, p)), ""), F.element_at(gaps, -1))
    new = F.when(F.size("found") > 0, joined).otherwise(text)
    return found.select(
        *[(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns],
        F.filter(F.transform("found", lambda e: e["kind"]), lambda k: k.isNotNull()).alias("pii_kinds"),
    )


def rewrite(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with its columns, ``text`` rewritten and ``n_chars``, where there
    is one, counted anew for the rows that changed."""
    done = replace_pii(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), key=key)
    changed = F.size("pii_kinds") > 0
    return done.select(*[
        F.col("text") if c == "text" else
        F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
        F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ])
