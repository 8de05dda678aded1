"""Personal data replaced by keyed surrogates of the same kind.

Entities are found by patterns.  Each distinct entity of the corpus gets one
surrogate, derived from a secret key: digits for digits, letters for letters of the
same script and case, octets for octets, given names of the same gender and script.
Card numbers and IBANs are found, and drawn, with right check digits.
So an entity reads the same wherever it stands.  Surrogates that two entities share,
or that are an entity of the corpus, are drawn again until none is left.

A name is found after a title.  Where a document has titled names, those full names
and their family names are replaced in that document without a title too.  The family
name of a full name gets the surrogate that it has alone.

Everything is SQL expressions, joins and aggregates on the DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.core import bind
from gatehouse.session import materialise

from .common import own_names

FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madame", "Frau", "Señora")
MALE_TITLES = ("Mr", "Herr", "Señor", "Monsieur")
OTHER_TITLES = ("Dr", "Prof")
GIVEN = {
    ("f", "Latin"): ("anna", "clara", "elena", "frida", "greta", "helena", "irina", "julia", "laura", "maria", "nora", "sofia"),
    ("m", "Latin"): ("adam", "bruno", "carlo", "daniel", "emil", "felix", "hugo", "jonas", "leon", "martin", "oscar", "pablo"),
    ("f", "Cyrillic"): ("анна", "вера", "дарья", "елена", "ирина", "ольга"),
    ("m", "Cyrillic"): ("антон", "борис", "иван", "олег", "павел", "роман"),
}
SYLLABLES = {"Latin": ("ba", "do", "fe", "ga", "ki", "lo", "mu", "na", "po", "ra", "se", "ti", "vo", "wi", "ya", "zu"),
             "Cyrillic": ("ба", "во", "га", "де", "ки", "ло", "му", "на", "по", "ра", "се", "ти", "фо", "хи", "ша", "зу")}

_TITLE = "(?:" + "|".join((*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES)) + ")"
_GROUP = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "EMAIL": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "SECRET": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Fa-f])|(?<=[=:\"' ])(?=[A-Za-z0-9_-]{12})(?<=[=:]\s{0,3}[\"']?)(?<=(?i:token|secret|password|api.?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_-]{12,}",
    "IBAN": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "PHONE": r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    "IPV6": rf"(?<![0-9A-Fa-f:])(?:{_GROUP}:){{7}}{_GROUP}(?![0-9A-Fa-f:])|(?<![0-9A-Fa-f:])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?=[A-Fa-f:]*[0-9])(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}(?![0-9A-Fa-f:])",
    "IP": r"(?<![\d.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\.?\d)",
    "SSN": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "CARD": r"(?<!\p{N})(?:\d{13,19}|\d{4}[ -]\d{4}(?:[ -]\d{4}){2}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\p{N})",
    "NAME": r"(?<= )(?=\p{Lu}\p{Ll})(?<=\b" + _TITLE + r"\.? )\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)?",
}
"""Entity kinds in order of preference, as Java patterns; cards and IBANs must pass their check digits besides."""

PHONE_DIGITS = 10
"""Last digits that tell phone numbers apart: what stands before is a country code, which some mentions leave out, and stays."""

ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
TITLED = rf"\b({_TITLE})\.? (\p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)?)"
"""A title and the name after it."""

SECRET_WORD = "(?i:token|secret|password|api.?key)"
"""What introduces a secret."""

MAX_ROUNDS = 20


def pattern(text: Column) -> Column:
    """What to look for in a text: ``ANY``, and without a title the full and family names that stand after titles there."""
    full = F.regexp_extract_all(text, F.lit(TITLED), F.lit(2))
    names = F.array_distinct(F.concat(full, F.transform(full, _family)))
    # In descending order a longer name comes before its own beginning.
    mentions = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?:"), F.array_join(F.sort_array(names, asc=False), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(_titled(text) & (F.size(full) > 0), mentions).otherwise(ANY)


def entities(text: Column) -> Column:
    """All entities of a text in order; of a name, its title stays outside."""
    return F.regexp_extract_all(text, pattern(text), F.lit(0))


def _family(name: Column) -> Column:
    """The family name: what stands after the space, or all of the name."""
    return F.substring_index(name, " ", -1)


def may_hold(text: Column) -> Column:
    """A quick test that every text with an entity passes: a digit, an at sign, a title, or what a secret of letters has."""
    return text.rlike("[0-9@]") | _titled(text) | text.rlike(SECRET_WORD + "|[A-Fa-f]{32}")


def _titled(text: Column) -> Column:
    return reduce(Column.__or__, (text.contains(t) for t in (*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES)))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of a text of digits; the last digit is doubled for ``doubled`` = 0, the one before it for 1."""
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i"))), F.lit(0), lambda acc, x: acc + F.when(
        x["i"] % 2 == doubled, 2 * x["d"] - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"]))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of lower-case letters and digits, read as a number with a = 10 to z = 35."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(
        c.rlike("[0-9]"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 87) % 97)


def is_entity(entity: Column) -> Column:
    """False for what looks like a card or an IBAN and fails its check digits."""
    value = F.lower(F.regexp_replace(entity, "[^0-9A-Za-z]", ""))
    kind = _kind(entity)
    moved = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))
    return F.when(kind == "CARD", _luhn_sum(value, 1) % 10 == 0).when(kind == "IBAN", _mod97(moved) == 1).otherwise(True)


def _kind(entity: Column) -> Column:
    """Kind by the entity's own look."""
    return (F.when(entity.contains("@"), "EMAIL")
            .when(entity.rlike("^[0-9A-Fa-f:]+$") & entity.contains(":"), "IPV6")
            .when(entity.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "IP")
            .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "SSN")
            .when(entity.rlike(r"^[+(]"), "PHONE")
            .when(entity.rlike(r"^[0-9A-Fa-f]{32,}$"), "SECRET")
            .when(entity.rlike(r"^\d[\d -]{12,}$"), "CARD")
            .when(entity.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{12,}$"), "IBAN")
            .when(entity.rlike(r"^\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)?$"), "NAME")
            .otherwise("SECRET"))


def _canonical(kind: Column, entity: Column) -> Column:
    """What makes two mentions one entity: case and, but for addresses, separators do not count, nor does a phone number's country code."""
    plain = F.lower(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""))
    return (F.when(kind.isin("EMAIL", "IP", "IPV6", "NAME"), F.lower(entity)).when(kind == "SECRET", entity)
            .when(kind == "PHONE", F.right(plain, F.lit(PHONE_DIGITS))).otherwise(plain))


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _byte(i: Column) -> Column:
    """Byte ``i`` (from 0) of the row's keyed stream, which repeats after 256 bytes."""
    return F.conv(F.substr("stream", (i % 256 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(c: Column, b: Column, hex_only: Column) -> Column:
    def from_(alphabet: str) -> Column:
        return _pick(tuple(alphabet), b)

    return (F.when(c.rlike("[0-9]"), from_("0123456789"))
            .when(c.rlike("[a-f]") & hex_only, from_("abcdef")).when(c.rlike("[A-F]") & hex_only, from_("ABCDEF"))
            .when(c.rlike("[a-z]"), from_("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), from_("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"\p{IsCyrillic}"), from_("абвгдежзиклмнопрстуфхцчшщэюя"))
            .when(c.rlike(r"\p{IsGreek}"), from_("αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike(r"\p{IsLatin}"), from_("àáâäçèéêëìíîïñòóôöùúûü"))
            .when(c.rlike(r"\p{IsHan}"), from_("丁七万丈三上下不与丑专且世丘丙业"))
            .when(c.rlike(r"\p{N}"), from_("0123456789")).when(c.rlike(r"\p{L}"), from_("abcdefghijklmnopqrstuvwxyz"))
            .otherwise(c))


def draw(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``surrogate`` to rows of kind, value, gender, attempt, and family, the surrogate of a full name's family name."""
    seed = F.concat_ws("|", F.lit(key), "kind", "value", F.col("attempt").cast("string"))
    stream = F.concat(*(F.sha2(F.concat(seed, F.lit(f"|{n}")), 512) for n in range(4)))
    value, n = F.col("value"), F.length("value")
    fixed_from = F.when(F.col("kind") == "EMAIL", n - F.length(F.substring_index("value", ".", -1))).otherwise(n)
    fixed_to = F.when(F.col("kind") == "IBAN", 2).otherwise(0)
    hex_only = (F.col("kind") == "IPV6") | (F.col("kind") == "SECRET") & value.rlike("^[0-9A-Fa-f]+$")
    by_letter = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when((i > fixed_from) | (i <= fixed_to), F.substr(value, i, F.lit(1)))
                                         .otherwise(_letter(F.substr(value, i, F.lit(1)), _byte(i), hex_only))), "")
    number = F.substr(by_letter, F.lit(1), n - 1)
    card = F.concat(number, (F.pmod(10 - _luhn_sum(number, 0) % 10, F.lit(10))).cast("string"))
    country, account = F.substr(value, F.lit(1), F.lit(2)), F.substr(by_letter, F.lit(5))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(i) % 254 + 1).cast("string")), ".")

    def name(script: str) -> Column:
        def syllables(at: int) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(0), F.col("attempt") + 2), lambda i: _pick(SYLLABLES[script], _byte(i + at))), "")

        def given(gender: str) -> Column:  # one given name, and one more for each further attempt
            return F.array_join(F.transform(F.sequence(F.lit(0), F.col("attempt")), lambda i: _pick(GIVEN[gender, script], _byte(i))), "")

        first = F.when(F.col("gender") == "f", given("f")).otherwise(given("m"))
        return (F.when(value.contains(" "), F.concat(first, F.lit(" "), F.col("family")))
                .when(value.contains("-"), F.concat(syllables(8), F.lit("-"), syllables(108))).otherwise(syllables(8)))

    names = F.when(value.rlike(r"\p{IsCyrillic}"), name("Cyrillic")).otherwise(name("Latin"))
    return entities.withColumn("stream", stream).withColumn(
        "surrogate", F.when(F.col("kind") == "IP", octets).when(F.col("kind") == "NAME", names).when(F.col("kind") == "CARD", card).when(F.col("kind") == "IBAN", iban)
        .otherwise(by_letter)).drop("stream")


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct entities; no two of a kind share a surrogate and none is an entity of the corpus.

    Of entities that draw the same, the smallest keeps it.  ``found`` has kind, value, gender.
    Full names come last, as they take over the surrogates of their family names.
    """
    known = materialise(found.groupBy("kind", "value").agg(F.max("gender").alias("gender")))
    is_full = (F.col("kind") == "NAME") & F.col("value").contains(" ")
    full = known.filter(is_full)
    family = full.select("kind", _family(F.col("value")).alias("value")).distinct()
    alone = known.filter(~is_full).select("kind", "value").unionByName(family).distinct()
    unlike = known.select("kind", "value").unionByName(family).distinct()
    good = _distinct(alone.withColumn("gender", F.lit(None).cast("string")).withColumn("family", F.lit(None).cast("string")), unlike, None, key)
    if not full.isEmpty():
        families = good.filter("kind = 'NAME'").select(F.col("value").alias("last"), F.col("surrogate").alias("family"))
        named = full.join(families, _family(F.col("value")) == F.col("last")).drop("last")
        good = _distinct(named, unlike, good, key)
    return good.join(known.select("kind", "value"), ["kind", "value"], "left_semi")


def _distinct(todo: DataFrame, unlike: DataFrame, good: DataFrame | None, key: str) -> DataFrame:
    """``good`` and a surrogate of its own for every row of ``todo``, none of them a value of ``unlike``."""
    todo = todo.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ROUNDS):
        drawn = materialise(draw(todo, key))
        taken = [unlike.select("kind", F.col("value").alias("surrogate"))] + ([] if good is None else [good.select("kind", "surrogate")])
        free = drawn.join(reduce(DataFrame.union, taken), ["kind", "surrogate"], "left_anti")
        winners = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        good = materialise(winners if good is None else good.unionByName(winners))
        todo = materialise(drawn.drop("surrogate").join(winners, ["kind", "value"], "left_anti").withColumn("attempt", F.col("attempt") + 1))
        if todo.isEmpty():
            return good
    raise ValueError(f"some entities found no surrogate of their own in {MAX_ROUNDS} rounds; is a kind's space used up?")


def _rendered(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own case and separators; what a mention has before it, a country code, stays."""
    def place(acc: Column, c: Column) -> Column:
        new = F.substr(surrogate, acc.n + 1, F.lit(1))
        cased = F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
        used = kind.isin("EMAIL", "IPV6") | c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(acc.out, F.when(used & (acc.n >= 0), cased).otherwise(c)).alias("out"), (acc.n + F.when(used, 1).otherwise(0)).alias("n"))

    own = F.length(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""))
    start = F.struct(F.lit("").alias("out"), F.when(kind == "PHONE", F.length(surrogate) - own).otherwise(0).alias("n"))
    by_letter = F.aggregate(F.split(entity, ""), start, place, lambda a: a.out)
    return F.when(kind == "IP", surrogate).when(kind == "SECRET", surrogate).when(kind == "NAME", F.initcap(surrogate)).otherwise(by_letter)


def _gender(text: Column) -> Column:
    return F.when(text.isin(*FEMALE_TITLES), "f").when(text.isin(*MALE_TITLES), "m")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``__entities``, how many were replaced.

    Null and empty texts and texts without entities stay as they are.  Repeated rows
    are rewritten alike.  A name is found after a title; the full names found in a text
    and their family names, in the same case, are replaced there without a title too.  A
    given name alone, or a name that no title introduces in its text, stays.  The gender of
    a full name is its title's.  One entity with titles of both genders counts as male.
    Numbers that look like cards or IBANs and fail their check digits stay.  Two ways to
    shorten one IPv6 address count as two.
    """
    marked = docs.withColumn("__pattern", F.when(may_hold(F.col("text")), pattern(F.col("text"))))
    marked = marked.withColumn("__found", F.regexp_extract_all(F.col("text"), F.col("__pattern"), F.lit(0)))
    # A secret may look like a card or an IBAN; what introduces it decides, not its digits.
    secrets = F.regexp_extract_all(F.col("text"), F.lit(PATTERNS["SECRET"]), F.lit(0))

    def judged(found: Column) -> Column:
        # Bound, so that only a text with such a span is searched for secrets, and once for all spans.
        asked = F.when(F.exists(found, lambda e: ~is_entity(e)), secrets)
        return bind(asked, lambda known: F.transform(found, lambda e: F.struct(
            e.alias("entity"), (is_entity(e) | F.coalesce(F.array_contains(known, e), F.lit(False))).alias("counts"))))

    marked = marked.withColumn("__found", bind(F.col("__found"), judged))
    has = F.coalesce(F.exists("__found", lambda e: e.counts), F.lit(False))
    digest = F.xxhash64("text")
    titles, names = (F.when(_titled(F.col("text")), F.regexp_extract_all(F.col("text"), F.lit(TITLED), F.lit(n))) for n in (1, 2))
    titled = F.arrays_zip(titles.alias("title"), names.alias("name"))
    # Spans and titles once: the texts are not looked through again for them.
    keyed = marked.filter(has).select(F.col("doc_id").alias("__id"), digest.alias("__digest"), "__found", titled.alias("__titled")).distinct()
    keyed = materialise(keyed)
    span = keyed.select("__id", "__digest", F.posexplode("__found").alias("__at", "e")).select("__id", "__digest", "__at", F.col("e.entity").alias("__entity"), "e.counts")
    stays = span.filter("NOT counts").select("__id", "__digest", "__at", F.col("__entity").alias("new"), F.lit(0).alias("one"))
    kind = F.when(is_entity(F.col("__entity")), _kind(F.col("__entity"))).otherwise("SECRET")
    mention = span.filter("counts").withColumn("kind", kind).withColumn("value", _canonical(F.col("kind"), F.col("__entity")))
    genders = keyed.select(F.explode("__titled").alias("t")).select(
        F.lit("NAME").alias("kind"), F.lower("t.name").alias("value"), _gender(F.col("t.title")).alias("gender"))
    found = mention.select("kind", "value", F.lit(None).cast("string").alias("gender")).unionByName(genders)
    table = surrogate_table(found, key)
    replaced = mention.join(table, ["kind", "value"]).select(
        "__id", "__digest", "__at", _rendered(F.col("kind"), F.col("__entity"), F.col("surrogate")).alias("new"), F.lit(1).alias("one"))
    new = replaced.unionByName(stays).groupBy("__id", "__digest").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__at", "new"))), lambda s: s.new).alias("__new"), F.sum("one").alias("__entities"))
    between = F.split("text", F.col("__pattern"), -1)
    text = F.array_join(F.flatten(F.zip_with(between, F.concat("__new", F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    changed = (marked.filter(has).join(new, F.col("doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__digest")))
               .withColumn("text", text))
    same = marked.filter(~has).withColumn("__entities", F.lit(0).cast("bigint"))
    columns = [*docs.columns, "__entities"]
    return changed.select(*columns).unionByName(same.select(*columns))


def surrogate_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_entities and the rewritten text, one row per row of ``docs``."""
    return replace_entities(docs.select("doc_id", "text"), key).select("doc_id", F.col("__entities").alias("n_entities"), "text")


@own_names
def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs``, same columns, with surrogates in ``text`` and ``n_chars`` to match.  Other columns may have any names."""
    new = replace_entities(docs, key)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("__entities") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)
