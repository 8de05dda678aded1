"""Words, sentences, bullets, shapes and other plain-text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .core import (
    bind, contains_any, extract, extract_all, first_reason, lookup, non_empty, trim_space,
)


# --- words -------------------------------------------------------------------
def norm_words(text: Column) -> Column:
    """Lower-case ``[a-z0-9]`` words, no empty tokens.

    Splitting between words is about ten times faster than extracting them.
    """
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def fields(text: Column) -> Column:
    """Whitespace-separated fields."""
    return non_empty(F.split(text, f"{V.ANY_SPACE}+"))


def word_count(text: Column) -> Column:
    return F.size(fields(text))


def words(text: Column) -> Column:
    """Words that keep percent signs and inner apostrophes."""
    return extract_all(text, "[A-Za-z0-9%]+(?:['’][A-Za-z0-9]+)?")


def ngrams(items: Column, n: int) -> Column:
    """Every run of ``n`` neighbouring items, as an array of arrays."""
    return bind(items, lambda w: F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.slice(w, i, n)),
    ).otherwise(F.array().cast("array<array<string>>")))


def gram_texts(items: Column, n: int) -> Column:
    """Distinct runs of ``n`` items, each joined with one blank."""
    return F.array_distinct(F.transform(ngrams(items, n), lambda g: F.array_join(g, " ")))


def gram_hashes(items: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``n`` items."""
    return F.array_distinct(F.transform(ngrams(items, n), lambda g: F.xxhash64(g)))


def shares_run(left: Column, right: Column, n: int) -> Column:
    """Do two word arrays share a run of ``n`` words?

    Hashes decide for almost every row; only where they meet are the runs
    themselves built and compared.
    """
    return any_shares_run(left, F.array(right), n)


FEW_RUNS = 64
"""Up to so many runs are searched for in the source itself, beyond that its runs are hashed."""


def any_shares_run(source: Column, units: Column, n: int) -> Column:
    """Does any of the word arrays in ``units`` share a run of ``n`` words with ``source``?

    Words hold no blanks.  The few runs of short units are looked for in the source's words
    in a row, which takes no array per word of the source.  Many runs meet the source's by
    hash; the source is hashed once, whatever the number of units.
    """
    def texts(w: Column) -> Column:
        return F.transform(ngrams(w, n), lambda g: F.array_join(g, " "))

    def hashes(w: Column) -> Column:
        return F.transform(ngrams(w, n), lambda g: F.xxhash64(g))

    def few(u: Column) -> Column:
        return F.aggregate(u, F.lit(0), lambda k, w: k + F.greatest(F.coalesce(F.size(w), F.lit(0)) - (n - 1), F.lit(0))) <= FEW_RUNS

    def padded(text: Column) -> Column:
        return F.concat(F.lit(" "), text, F.lit(" "))

    def searched(x: Column) -> Column:
        return bind(padded(F.array_join(x["s"], " ")), lambda row: F.exists(
            F.flatten(F.transform(x["u"], texts)), lambda run: row.contains(padded(run))))

    return bind(F.struct(source.alias("s"), units.alias("u")), lambda x: F.when(
        few(x["u"]), F.coalesce(searched(x), F.lit(False)),
    ).when(
        F.arrays_overlap(hashes(x["s"]), F.flatten(F.transform(x["u"], hashes))),
        F.arrays_overlap(texts(x["s"]), F.flatten(F.transform(x["u"], texts))),
    ).otherwise(F.lit(False)))


# --- units -------------------------------------------------------------------
def sentences(text: Column) -> Column:
    """Split after ``. ! ?`` followed by whitespace (marks are consumed)."""
    return F.split(trim_space(text), "[.!?]" + V.ASCII_SPACE + "+")


def kept_sentences(text: Column) -> Column:
    """Sentences with their end marks, blanks dropped."""
    return non_empty(F.split(trim_space(text), f"(?<=[.!?]){V.ANY_SPACE}+"))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def bullets(text: Column) -> Column:
    """Lines led by ``-``, ``•`` or ``*``, without their markers."""
    led = F.filter(F.transform(lines(text), trim_space), lambda t: t.rlike("^[-•*]"))
    return F.transform(led, lambda t: F.regexp_replace(t, "^[-•* ]+", ""))


def listed_lines(text: Column) -> Column:
    """Bulleted or numbered lines (``1.`` and ``1)`` count)."""
    lead = f"^{V.ANY_SPACE}*(?:[-*•]|[0-9]+[.)]){V.ANY_SPACE}+"
    return F.filter(lines(text), lambda t: t.rlike(lead))


# --- prompt structure --------------------------------------------------------
def quoted_source(prompt: Column) -> Column:
    """Text between the first and the last single quote."""
    return extract(prompt, "(?s)'(.+)'")


def quoted_parts(prompt: Column, category: Column) -> Column:
    """STRUCT<instruction, source> of a prompt whose source follows ``: '``."""
    blank = r"(?s)^(.*?): '(.*)'(.*)$"
    para = r"(?s)^(.*?):\n\n'(.*)'(.*)$"
    use_blank = prompt.contains(": '")

    def part(group: int) -> Column:
        return F.when(use_blank, F.regexp_extract(prompt, blank, group)).otherwise(
            F.regexp_extract(prompt, para, group))

    head, source, tail = (trim_space(part(i)) for i in (1, 2, 3))
    instruction = F.concat(head, F.when(tail != "", F.concat(F.lit(" "), tail)).otherwise(F.lit("")))
    eligible = category.isin("sentiment_classification", "text_summarisation", "named_entity_recognition")
    return F.when(
        eligible & (instruction != "") & (source != ""),
        F.struct(instruction.alias("instruction"), source.alias("source")),
    )


def stated_shape(prompt: Column) -> Column:
    """STRUCT<n, unit, cap>: demanded unit count and per-item word cap."""
    count = extract(prompt, V.UNIT_COUNT, 1)
    cap = F.lower(extract(prompt, V.WORD_CAP, 1))
    return F.struct(
        F.coalesce(lookup(count, V.UNIT_COUNT_WORDS),
                   count.try_cast("int")).alias("n"),
        extract(prompt, V.UNIT_COUNT, 2).alias("unit"),
        F.nullif(F.coalesce(lookup(cap, V.WORD_CAP_WORDS), cap.try_cast("int")), F.lit(0)).alias("cap"),
    )


def contrast_flags(text: Column) -> Column:
    """STRUCT<contrast, praise, tail_praise>: two-sidedness and where it resolves.

    ``praise`` and ``tail_praise`` ignore negated praise; the tail is what follows
    the last contrast cue.
    """
    unnegated = F.regexp_replace(text, V.NEGATED_PRAISE_CUES, "")
    tail = extract(text, f"(?s)^.*{V.CONTRAST_CUES}(.*)$")
    return F.struct(
        text.rlike(V.CONTRAST_CUES).alias("contrast"),
        unnegated.rlike(V.PRAISE_CUES).alias("praise"),
        F.coalesce(F.regexp_replace(tail, V.NEGATED_PRAISE_CUES, "").rlike(V.PRAISE_CUES),
                   F.lit(False)).alias("tail_praise"),
    )


# --- labels ------------------------------------------------------------------
def sentiment_label(text: Column, lenient: bool = False, window: int | None = None) -> Column:
    """First sentiment label of the whole text; lenient reads it in any case.

    A caller may look at the first ``window`` characters only.
    """
    text = text if window is None else F.substr(text, F.lit(1), F.lit(window))
    core = V.WORD_START + "(Positive|Negative|Neutral)" + V.WORD_END
    if lenient:
        return F.initcap(extract(text, "(?i)" + core))
    return extract(text, core)


def keyword_category(prompt: Column) -> Column:
    """Category of the first keyword rule that fits, else factual knowledge."""
    return bind(F.lower(prompt), _category_of_lower)


def _category_of_lower(low: Column) -> Column:
    checks = []
    for category, needles in V.KEYWORD_RULES:
        hit = contains_any(low, needles)
        if category == "code_debugging":
            hit = hit | _evaluates(low)
        if category == "logical_deductive_reasoning":
            hit = hit | (low.contains("if all ") & low.contains("are all "))
        checks.append((hit, category))
    return F.coalesce(first_reason(*checks), F.lit("factual_knowledge"))


def evaluates_code(prompt: Column) -> Column:
    """Does the prompt ask what a piece of code evaluates to?"""
    return bind(F.lower(prompt), _evaluates)


def _evaluates(low: Column) -> Column:
    return contains_any(low, ["code", "def "]) & contains_any(low, V.EVALUATES_MARKERS)


def category_from_id(task_id: Column) -> Column:
    """Short category from a task id: sample ids first, then longest prefix."""
    sample = lookup(F.substr(task_id, F.lit(1), F.lit(3)), V.SAMPLE_IDS)
    by_prefix = first_reason(*[(task_id.startswith(p), c) for p, c in V.ID_PREFIXES])
    return F.coalesce(sample, by_prefix, F.lit("unknown"))


def canonical_category(short: Column) -> Column:
    return F.coalesce(lookup(short, V.CANONICAL_CATEGORY), short)


# --- trimming ----------------------------------------------------------------
def trim_to_word_cap(prompt: Column, answer: Column) -> Column:
    """Cut over-long bullets to the stated word cap.

    The cut prefers the last clause mark in the second half of the allowance.  A
    hard cut drops a late relative clause and dangling function words.
    """
    cap = stated_shape(prompt)["cap"]
    return F.when(cap.isNull(), answer).otherwise(bind(cap, lambda limit: F.array_join(
        F.transform(lines(answer), lambda line: _capped_line(line, limit)), "\n")))


def _capped_line(line: Column, limit: Column) -> Column:
    bare = trim_space(line)
    marker = F.regexp_extract(bare, "^([-•*] )", 1)
    kept = bind(fields(F.substr(bare, F.lit(3))), lambda w: F.when(
        F.size(w) > limit, F.array_join(F.slice(w, 1, _cut_point(w, limit)), " ")))
    shortened = F.concat(marker, F.regexp_replace(kept, "[,;:]+$", ""), F.lit("."))
    return F.when(marker == "", line).otherwise(F.coalesce(shortened, line))


def _cut_point(w: Column, limit: Column) -> Column:
    lowest = F.greatest(F.floor(limit / 2).cast("int"), F.lit(1))
    clause = F.array_max(F.filter(
        F.sequence(F.lit(1), limit),
        lambda j: (j >= lowest) & (j < limit) & F.get(w, j - 1).rlike("[,;:]$")))
    late = [F.lower(F.get(w, limit - k)).isin(V.RELATIVISERS) & (limit > k) for k in (2, 3)]
    hard = F.when(late[0], limit - 2).when(late[1], limit - 3).otherwise(limit)
    content_end = F.array_max(F.filter(
        F.sequence(F.lit(1), hard),
        lambda j: ~F.lower(F.regexp_replace(F.get(w, j - 1), "^[,;:.]+|[,;:.]+$", "")).isin(V.FUNCTION_WORDS)))
    return F.coalesce(clause, content_end, F.lit(1))


def trim_middle(text: Column, limit: Column | int) -> Column:
    """Head two thirds, a note, and the tail that still fits (code points)."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.floor(limit * 2 / 3).cast("int")
    tail = F.greatest(limit - head - V.MIDDLE_NOTE_ALLOWANCE, F.lit(0))
    cut = F.concat(F.substr(text, F.lit(1), head), F.lit(V.MIDDLE_NOTE), F.right(text, tail))
    return F.when((limit <= 0) | (F.length(text) <= limit), text).otherwise(cut)


def truncate_trace(text: Column, limit: int) -> Column:
    """Equal head and tail around an ellipsis line."""
    bare, half = trim_space(text), limit // 2
    cut = F.concat(F.substr(bare, F.lit(1), F.lit(half)), F.lit("\n...\n"), F.right(bare, F.lit(half)))
    return F.when(F.length(bare) <= limit, bare).otherwise(cut) if limit > 0 else bare


def truncate_note(text: Column, limit: int, on: Column | None = None) -> Column:
    """Head plus a note that says where and when it was cut."""
    day = F.date_format(F.current_date() if on is None else on, "dd MMMM yyyy")
    note = F.concat(F.lit(f"\n[...truncated at {limit} characters on "), day, F.lit("...]\n"))
    return F.when((F.lit(limit) <= 0) | (F.length(text) <= limit), text).otherwise(
        F.concat(F.substr(text, F.lit(1), F.lit(limit)), note))


def head_tail_tokens(tokens: Column, limit: int, head: int) -> Column:
    """Keep the first ``head`` tokens and fill up to ``limit`` from the end."""
    tail = limit - head
    return F.when(F.size(tokens) <= limit, tokens).otherwise(
        F.concat(F.slice(tokens, 1, head), F.slice(tokens, -tail, tail)))


def ascii_fold(text: Column) -> Column:
    """Typographic marks to ASCII, tabs to blanks, any other character to ``?``."""
    source, target = V.FOLD_CHARS
    folded = F.replace(text, F.lit(V.FOLD_ELLIPSIS), F.lit("..."))
    folded = F.translate(folded, source + " \t", target + "  ")
    return F.regexp_replace(folded, r"[^\n\r -~]", "?")


def front_matter(text: Column, fallback: Column) -> Column:
    """STRUCT<name, description> from a leading ``---`` block."""
    head = extract(F.regexp_replace(text, "^\ufeff", ""), r"(?s)^---\n(.*?)\n---")

    def value(key: str) -> Column:
        pairs = F.filter(lines(head), lambda ln: ln.rlike(f"^{V.ANY_SPACE}*{key}{V.ANY_SPACE}*:"))
        raw = trim_space(F.regexp_replace(F.get(pairs, F.size(pairs) - 1), "^[^:]*:", ""))
        return F.regexp_replace(raw, "^['\"]+|['\"]+$", "")

    return F.struct(
        F.coalesce(F.nullif(value("name"), F.lit("")), fallback).alias("name"),
        F.coalesce(value("description"), F.lit("")).alias("description"),
    )


