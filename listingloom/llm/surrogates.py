"""Personal data replaced by keyed surrogates of the same kind, with built-in functions only.

An entity is normalised (an address in lower case, a number without its punctuation) and
written as a row of places: a value, the number of values its place may have, and the
alphabet they come from. A keyed permutation of all such rows, an alternating Feistel
network in which every second place is moved by a hash of the other places, gives the
surrogate, which is then put back into the entity's own spelling. The network runs
backwards, one place moves on, and it runs forwards, so that no row stays as it was,
not even one of a single place. Because it is a permutation, different entities of one kind get different surrogates and every mention of
one entity gets the same, without a table that grows with the corpus; letters stay letters
of their script and case, vowels stay vowels, card numbers keep their check digit valid or
invalid, addresses keep the ending, phone numbers the country code, first names their
gender and script.

Distinctness is still checked on the corpus's entities before a text is rewritten. A key
that fails the check, which could only come from two kinds of spelling, is replaced by the
next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import texts

KEY = "surrogates-1"
ROUNDS = 4
ATTEMPTS = 8

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# First names by script and gender: a name's surrogate is another of its list.
FIRST_NAMES = {
    "latin_f": "Anna Clara Elena Emma Eva Helen Julia Laura Lucia Maria Marie Nina Paula Sara Sofia Vera",
    "latin_m": "Adam Carl Daniel David Erik Felix Jakob Jonas Lukas Martin Oscar Paul Peter Simon Thomas Viktor",
    "cyrillic_f": "Анна Вера Дарья Елена Ирина Мария Нина Ольга",
    "cyrillic_m": "Антон Борис Виктор Иван Олег Павел Сергей Юрий",
    "greek_f": "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία",
    "greek_m": "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος",
}
TITLES = "Mr Mrs Ms Miss Herr Frau Señor Señora Sr Sra Monsieur Madame Mme Господин Госпожа Κύριος Κυρία"
NAMES = "|".join(name for names in FIRST_NAMES.values() for name in names.split())
SURNAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"

# Kinds of entity in order of precedence. Runs begin at their edge and are possessive, so
# that a long run without an entity is read once.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z0-9-]*[A-Za-z0-9]",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)",
    "key": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES.split())})\.? (?:(?:{NAMES}) )?{SURNAME}|(?:{NAMES}) {SURNAME})(?!\p{{L}})",
}
# group numbers shift when patterns are joined, so the one back reference is named
KINDS["card"] = KINDS["card"].replace("([ -])", "(?<gap>[ -])").replace(r"\1", r"\k<gap>")
# Every kind begins where a word does, which most positions of a text fail at once.
ENTITY = rf"(?<![A-Za-z0-9])(?:{'|'.join(KINDS.values())})"

# Letters stay within these sets: vowels and others, by script and case.
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)


# --- places -----------------------------------------------------------------------


def place(value: Column, size: Column, alphabet: Column) -> Column:
    return F.struct(value.cast("int").alias("v"), size.cast("int").alias("m"), alphabet.alias("a"))


def fixed(letter: Column) -> Column:
    """A place with one value only."""
    return place(F.lit(0), F.lit(1), letter)


def letter_place(letter: Column) -> Column:
    found = fixed(letter)
    for alphabet in ALPHABETS:
        at = F.instr(F.lit(alphabet), letter)
        found = F.when(at > 0, place(at - 1, F.lit(len(alphabet)), F.lit(alphabet))).otherwise(found)
    return found


def letters_of(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def letter_places(text: Column) -> Column:
    return F.transform(letters_of(text), letter_place)


def octet_places(text: Column) -> Column:
    """Four numbers of a byte each; an empty alphabet writes the number itself."""
    return F.transform(F.split(text, r"\."), lambda o: place(o.cast("int"), F.lit(256), F.lit("")))


def name_place(first: Column) -> Column:
    found = fixed(first)
    for names in FIRST_NAMES.values():
        known = F.array(*map(F.lit, names.split()))
        at = F.array_position(known, first)
        found = F.when(
            at > 0, place(at - 1, F.size(known), F.array_join(known, " "))
        ).otherwise(found)
    return found


def permuted(places: Column, kind: Column, key: Column) -> Column:
    """A keyed permutation without fixed points, on rows that have a place to move.

    Each round moves every second place by a hash of the others. The rounds are undone,
    the first place that can is moved on by a keyed step that is not its size, and the
    rounds are done: what comes out equals what went in only if the step did nothing.
    """

    def shape(done: Column) -> Column:
        """The rows of one permutation have the same sizes of places."""
        return F.array_join(F.transform(done, lambda q: q["m"].cast("string")), ",")

    def hashed(*parts: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", key, kind, *parts), 256)
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")

    def round_(done: Column, number: Column, sign: int) -> Column:
        def move(p: Column, k: Column) -> Column:
            rest = F.array_join(
                F.transform(
                    F.filter(done, lambda _, i: i % 2 != number % 2), lambda q: q["v"].cast("string")
                ),
                ",",
            )
            shift = hashed(number.cast("string"), shape(done), rest, k.cast("string")) * F.lit(sign)
            moved = place(F.pmod(p["v"] + shift, p["m"]), p["m"], p["a"])
            return F.when((k % 2 == number % 2) & (p["m"] > 1), moved).otherwise(p)

        return F.transform(done, move)

    def moved_on(done: Column) -> Column:
        first = F.array_position(F.transform(done, lambda p: p["m"] > 1), F.lit(True)) - 1

        def move(p: Column, k: Column) -> Column:
            step = F.lit(1) + F.pmod(hashed(F.lit("step"), shape(done)), p["m"] - 1)
            moved = place(F.pmod(p["v"] + step, p["m"]), p["m"], p["a"])
            return F.when((p["m"] > 1) & (k == first), moved).otherwise(p)

        return F.transform(done, move)

    forwards, backwards = list(range(ROUNDS)), list(reversed(range(ROUNDS)))
    undone = F.aggregate(F.array(*map(F.lit, backwards)), places, lambda d, n: round_(d, n, -1), moved_on)
    return F.aggregate(F.array(*map(F.lit, forwards)), undone, lambda d, n: round_(d, n, 1))


def spelt(places: Column) -> Column:
    """Places back to text."""

    def write(p: Column) -> Column:
        words = F.split(p["a"], " ")
        return (
            F.when(p["m"] == 1, p["a"])
            .when(p["a"] == "", p["v"].cast("string"))
            .when(F.contains(p["a"], F.lit(" ")), F.get(words, p["v"]))
            .otherwise(F.substring(p["a"], p["v"] + F.lit(1), F.lit(1)))
        )

    return F.array_join(F.transform(places, write), "")


# --- kinds ------------------------------------------------------------------------


def kind_of(entity: Column) -> Column:
    found = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        found = F.when(entity.rlike(rf"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(found)
    return found


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def country_code(entity: Column) -> Column:
    """The digits before the national number, which stay as they are."""
    written = F.regexp_extract(entity, r"^\+(\d{1,3}?)(?=[ .(-])", 1)
    return F.when(entity.startswith("+"), F.when(written != "", written).otherwise(F.substring(entity, 2, 1))).otherwise("")


def normalised(entity: Column, kind: Column) -> Column:
    """What all mentions of one entity have in common."""
    number = F.substring(digits_of(entity), F.length(country_code(entity)) + F.lit(1), F.lit(99))
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind == "phone", number)
        .when(kind == "card", digits_of(entity))
        .otherwise(entity)
    )


def luhn_digit(payload: Column) -> Column:
    """Check digit that makes a card number valid."""
    digits = F.reverse(letters_of(payload))
    doubled = F.transform(
        digits,
        lambda d, k: F.when(k % 2 == 1, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    total = F.aggregate(doubled, F.lit(0), lambda n, d: n + d)
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def surrogate(entity: Column, kind: Column, key: Column) -> Column:
    """A surrogate of a normalised entity, as a normalised entity."""

    def swapped(text: Column, purpose: str, to_places=letter_places) -> Column:
        return spelt(permuted(to_places(text), F.lit(purpose), key))

    def number(text: Column, purpose: str) -> Column:
        # a leading 0 or 1, which means something else, stays
        return F.when(
            text.rlike("^[2-9]"),
            spelt(
                permuted(
                    F.concat(
                        F.array(place(F.substring(text, 1, 1).cast("int") - 2, F.lit(8), F.lit("23456789"))),
                        letter_places(F.substring(text, 2, 99)),
                    ),
                    F.lit(purpose),
                    key,
                )
            ),
        ).otherwise(F.concat(F.substring(text, 1, 1), swapped(F.substring(text, 2, 99), purpose)))

    user = F.substring_index(entity, "@", 1)
    host = F.substring_index(entity, "@", -1)
    ending = F.regexp_extract(host, r"(\.[^.]*)$", 1)
    domain = F.substring(host, F.lit(1), F.length(host) - F.length(ending))
    payload = F.substring(entity, F.lit(1), F.length(entity) - 1)
    card = F.concat(F.substring(payload, 1, 1), swapped(F.substring(payload, 2, 99), "card"))
    off = F.substring(entity, -1, 1).cast("int") - luhn_digit(payload)
    words = F.split(entity, " ")
    titled = words[0].rlike(rf"^(?:{'|'.join(TITLES.split())})\.?$")

    def name(word: Column, k: Column) -> Column:
        known = word.rlike(rf"^(?:{NAMES})$")
        first = spelt(permuted(F.array(name_place(word)), F.lit("first"), key))
        return (
            F.when((k == 0) & titled, word)
            .when(known & (k < F.size(words) - 1), first)
            .otherwise(swapped(word, "surname"))
        )

    return (
        F.when(kind == "email", F.concat(swapped(user, "user"), F.lit("@"), swapped(domain, "domain"), ending))
        .when(kind == "ip", F.array_join(F.transform(permuted(octet_places(entity), kind, key), lambda p: p["v"].cast("string")), "."))
        .when(kind == "phone", number(entity, "phone"))
        .when(kind == "card", F.concat(card, F.pmod(luhn_digit(card) + off, F.lit(10)).cast("string")))
        .when(kind == "key", F.concat(F.substring(entity, 1, 4), swapped(F.substring(entity, 5, 99), "key")))
        .otherwise(F.array_join(F.transform(words, name), " "))
    )


def in_spelling_of(entity: Column, kind: Column, made: Column) -> Column:
    """A normalised surrogate written the way the entity is: its case, its punctuation."""
    code = F.length(country_code(entity))

    def digit(letter: Column, k: Column) -> Column:
        before = F.length(digits_of(F.substring(entity, F.lit(1), k)))
        put = F.substring(made, before - F.when(kind == "phone", code).otherwise(0) + 1, F.lit(1))
        stays = (kind == "phone") & (before < code)
        return F.when(letter.rlike(r"\d") & ~stays, put).otherwise(letter)

    def case(letter: Column, k: Column) -> Column:
        put = F.substring(made, k + F.lit(1), F.lit(1))
        return F.when(letter.rlike("[A-Z]"), F.upper(put)).otherwise(put)

    return (
        F.when(kind.isin("phone", "card"), F.array_join(F.transform(letters_of(entity), digit), ""))
        .when(kind == "email", F.array_join(F.transform(letters_of(entity), case), ""))
        .otherwise(made)
    )


# --- texts ------------------------------------------------------------------------


def entities_of(text: Column) -> Column:
    """All entities of a text, in order, without overlaps."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def described(entities: Column, key: Column) -> Column:
    """Entities as structs of the mention, its kind, its normal form and both surrogates."""
    kinds = F.transform(entities, lambda e: F.struct(e.alias("mention"), kind_of(e).alias("kind")))
    normal = F.transform(
        kinds, lambda e: F.struct(e["mention"], e["kind"], normalised(e["mention"], e["kind"]).alias("normal"))
    )
    made = F.transform(
        normal,
        lambda e: F.struct(e["mention"], e["kind"], e["normal"], surrogate(e["normal"], e["kind"], key).alias("made")),
    )
    return F.transform(
        made,
        lambda e: F.struct(
            e["mention"].alias("mention"), e["kind"].alias("kind"), e["normal"].alias("normal"),
            e["made"].alias("made"), in_spelling_of(e["mention"], e["kind"], e["made"]).alias("written"),
        ),
    )


def entity_table(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct entities: kind, normal, made."""
    found = texts(docs, id_col, text_col).select(F.explode(entities_of(F.col("text"))).alias("mention")).distinct()
    each = found.select(described(F.array("mention"), F.lit(key))[0].alias("e"))
    return each.select("e.kind", "e.normal", "e.made").distinct()


def collisions(table: DataFrame) -> DataFrame:
    """Surrogates that two different entities of one kind would share."""
    return table.groupBy("kind", "made").agg(F.count_distinct("normal").alias("n")).filter("n > 1")


def unchanged(table: DataFrame) -> DataFrame:
    """Entities that would stay as they are although a letter or digit of theirs could change."""
    last = F.element_at(F.split("normal", " "), -1)
    part = F.when(F.col("kind") == "email", F.regexp_replace("normal", r"\.[^.@]*$", "")).otherwise(last)
    return table.filter((F.col("made") == F.col("normal")) & part.rlike(f"[{''.join(ALPHABETS)}]"))


def checked_key(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> str:
    """The first key made from ``key`` that changes all entities of ``docs`` and keeps them apart."""
    for attempt in range(ATTEMPTS):
        tried = key if attempt == 0 else f"{key}/{attempt}"
        table = entity_table(docs, tried, id_col, text_col)
        clashes = collisions(table).select(F.col("kind"))
        if clashes.unionAll(unchanged(table).select("kind")).isEmpty():
            return tried
    raise ValueError("no key changes the entities and keeps them apart")


def surrogate_texts(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with surrogates, n_entities, kinds.

    A text without entities comes back as it is, a missing one as an empty text. Repeated
    rows are rewritten alike; an empty table gives no rows. The documents are not shuffled.
    """
    good = checked_key(docs, key, id_col, text_col)
    found = texts(docs, id_col, text_col).withColumn("_mentions", entities_of(F.col("text")))
    made = found.withColumn("_entities", described(F.col("_mentions"), F.lit(good)))
    between = F.split("text", ENTITY, -1)
    rewritten = F.array_join(
        F.zip_with(between, "_entities", lambda b, e: F.concat(b, F.coalesce(e["written"], F.lit("")))), ""
    )
    return made.select(
        "doc_id",
        F.when(F.size("_mentions") > 0, rewritten).otherwise(F.col("text")).alias("text"),
        F.size("_mentions").alias("n_entities"),
        F.array_sort(F.array_distinct(F.transform("_entities", lambda e: e["kind"]))).alias("kinds"),
    )
