"""Deterministic gates: each returns a reason, NULL meaning accepted.

A reason is a stable code, followed by ``: detail`` where a detail helps.  Gates
are Column functions, so batch and streaming tables share them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import entities as E
from ..functions import fixed as V
from ..functions import numbers as N
from ..functions import text as X
from ..functions.core import bind, contains_any, first_reason, trim_space


def reason_code(reason: Column) -> Column:
    """The code of a reason, without its detail."""
    return F.regexp_extract(reason, "^([^:]*)", 1)


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _detail(code: str, detail: Column) -> Column:
    return F.concat(F.lit(code + ": "), detail)


# --- sentiment ---------------------------------------------------------------
def gate_sentiment(prompt: Column, answer: Column) -> Column:
    """Label first, a justification, both sides of a two-sided text, no false Negative."""
    label = F.regexp_extract(answer, "^(Positive|Negative|Neutral|Mixed)", 1)
    reason = trim_space(F.regexp_replace(answer, r"^(?:Positive|Negative|Neutral|Mixed)\.?", ""))
    review = F.coalesce(X.quoted_source(prompt), prompt)
    return first_reason(
        (label == "", "no_leading_label"),
        (F.length(reason) < V.MIN_JUSTIFICATION, "no_justification"),
        (prompt.rlike(V.CONTRAST_CUES) & ~answer.rlike(V.CONTRAST_CUES), "one_sided_reason"),
        ((label == "Negative") & X.contrast_flags(review)["tail_praise"], "praise_labelled_negative"),
    )


# --- summaries ---------------------------------------------------------------
def summary_units(prompt: Column, answer: Column) -> Column:
    """Bullets or sentences, whichever the prompt asks for."""
    unit = X.stated_shape(prompt)["unit"]
    return F.when(unit == "bullet points", X.bullets(answer)).otherwise(X.sentences(answer))


def gate_summary_shape(prompt: Column, answer: Column) -> Column:
    """Stated unit count, word cap per unit, and a demanded percentage."""
    def judge(s: Column) -> Column:
        sizes = F.transform(s["units"], X.word_count)
        return first_reason(
            (s["shape"]["n"].isNull(), F.lit(None).cast("string")),
            (F.size(s["units"]) != s["shape"]["n"], F.concat(
                F.lit("unit_count: "), F.size(s["units"]).cast("string"), F.lit(" of "),
                s["shape"]["n"].cast("string"))),
            (F.exists(sizes, lambda k: k > s["shape"]["cap"]), "unit_over_cap"),
            (F.lower(prompt).contains("must mention the percentage") & ~answer.contains("%"),
             "percentage_missing"),
        )

    return bind(F.struct(summary_units(prompt, answer).alias("units"),
                         X.stated_shape(prompt).alias("shape")), judge)


def gate_summary_echo(prompt: Column, answer: Column) -> Column:
    """No unit may share a run of eight words with the quoted source."""
    def judge(source: Column) -> Column:
        units = F.transform(summary_units(prompt, answer), X.norm_words)
        return F.when(X.any_shares_run(source, units, V.ECHO_RUN), F.lit("source_echo"))

    return bind(X.norm_words(X.quoted_source(prompt)), judge)


def gate_summary_pivot(prompt: Column, answer: Column) -> Column:
    """Both sides of a contrast pivot in the middle of the source must be covered."""
    source = X.quoted_source(prompt)

    def long_words(t: Column) -> Column:
        return F.filter(X.norm_words(t), lambda w: F.length(w) >= V.PIVOT_MIN_LETTERS)

    def judge(s: Column) -> Column:
        said = long_words(answer)

        def place(marker: str, n: Column) -> Column:
            return bind(F.locate(marker, s) - 1, lambda at: F.when((at > F.floor(n / 5)) & (at < F.floor(n * 4 / 5)), at))

        pivot = bind(F.length(s), lambda n: F.coalesce(*[place(m, n) for m in V.PIVOT_MARKERS]))
        return bind(pivot, lambda at: first_reason(
            (~F.arrays_overlap(long_words(F.substr(s, F.lit(1), at)), said), "omits_before_pivot"),
            (~F.arrays_overlap(long_words(F.substr(s, at + 1)), said), "omits_after_pivot"),
        ))

    return bind(source, judge)


def gate_summary(prompt: Column, answer: Column) -> Column:
    """Shape first; echo and pivot only where the prompt states a shape."""
    stated = X.stated_shape(prompt)["n"].isNotNull()
    return F.coalesce(gate_summary_shape(prompt, answer), F.when(stated, F.coalesce(
        gate_summary_echo(prompt, answer), gate_summary_pivot(prompt, answer))))


# --- facts -------------------------------------------------------------------
def _compared_term(prompt: Column, group: int) -> Column:
    found = F.nullif(F.regexp_extract(prompt, V.DIFFERENCE_TERMS, group), F.lit(""))

    def cut(w: Column) -> Column:
        last = F.array_max(F.filter(
            F.sequence(F.lit(1), F.size(w)), lambda i: ~F.lower(F.get(w, i - 1)).isin(V.TERM_TAIL_WORDS)))
        return F.array_join(F.slice(w, F.lit(1), F.coalesce(last, F.lit(1))), " ")

    return F.when(found.isNotNull(), bind(X.fields(found), cut))


def gate_factual(prompt: Column, answer: Column) -> Column:
    """At most four sentences, no refusal, both compared terms named."""
    low = F.lower(answer)
    terms = [_compared_term(prompt, g) for g in (1, 2)]
    return first_reason(
        (F.size(X.sentences(answer)) > V.MAX_FACT_SENTENCES, "too_many_sentences"),
        (contains_any(low, V.REFUSALS), "refusal"),
        *[(~low.contains(F.lower(t)), _detail("term_missing", t)) for t in terms],
    )


# --- entities ----------------------------------------------------------------
def gate_entities(prompt: Column, answer: Column) -> Column:
    """Every entity signal of the prompt must appear in the answer."""
    def absent(items: Column) -> Column:
        return F.filter(items, lambda s: ~answer.contains(s))

    runs = F.filter(absent(E.name_runs(prompt)), lambda r: ~answer.contains(
        F.regexp_replace(r, "^[^ ]* ", "")))
    missing = [
        ("omits_year", absent(E.years(prompt))), ("omits_name", runs),
        ("omits_capital", absent(E.mid_capitals(prompt))), ("omits_acronym", absent(E.acronyms(prompt))),
    ]
    return F.coalesce(*[_detail(code, _first(items)) for code, items in missing],
                      gate_entity_labels(answer))


def gate_entity_labels(answer: Column) -> Column:
    """Labels that are wrong on their surface, and organisations hidden in the note."""
    def flaw(p: Column) -> Column:
        low, span = F.lower(p["span"]), p["span"]
        return first_reason(
            ((p["label"] == "LOCATION") & (span.rlike(V.ACRONYM_LED) | span.rlike(V.ALL_CAPS)),
             _detail("acronym_as_location", span)),
            ((low.contains("program") | low.contains("mission")) & (p["label"] != "ORGANIZATION"),
             _detail("programme_mislabelled", span)),
            ((p["label"] == "DATE") & ~span.rlike(V.DATE_SHAPE), _detail("not_a_date", span)),
        )

    flaws = F.array_compact(F.transform(E.labelled_spans(answer), flaw))
    note = F.regexp_extract(answer, f"(?s)({V.OUTSIDE_NOTE}.*)", 1)
    return F.coalesce(_first(flaws), _detail("organisation_in_note", _first(E.acronyms(note))))


# --- code --------------------------------------------------------------------
def code_to_parse(prompt: Column, answer: Column) -> Column:
    """Code whose syntax decides; NULL where a cheaper check already rejects."""
    body = C.code_body(answer)
    return F.when(_code_shape(prompt, body).isNull(), body)


def _code_shape(prompt: Column, body: Column) -> Column:
    name = C.called_name(prompt)
    return first_reason(
        (~body.contains(F.concat(F.lit("def "), name)), _detail("function_absent", name)),
        (name.isNull() & ~body.contains("def "), "no_definition"),
    )


def gate_code_static(prompt: Column, answer: Column, parses: Column) -> Column:
    """Requested function, syntax, and a worked example that could be run.

    ``parses`` is ``python_parses(code_to_parse(prompt, answer))``.
    """
    name = C.called_name(prompt)
    call_at = F.position(F.concat(name, F.lit("(")), prompt)
    rest = F.substr(prompt, call_at)
    return first_reason(
        (_code_shape(prompt, C.code_body(answer)).isNotNull(), _code_shape(prompt, C.code_body(answer))),
        (~parses, "does_not_parse"),
        (name.isNull(), "no_function_named"),
        (call_at == 0, "no_example_call"),
        (~rest.rlike(r"^[0-9A-Za-z_]+\([^\n]*?\) should return "), "example_not_executable"),
    )


def fix_to_parse(prompt: Column, answer: Column) -> Column:
    return F.when(_fix_shape(prompt, answer).isNull(), _fixed_code(answer))


def _fixed_code(answer: Column) -> Column:
    return F.when(answer.rlike(V.FENCED_CODE), F.regexp_extract(answer, V.FENCED_CODE, 1)).otherwise(
        C.from_first_def(answer))


def _fix_shape(prompt: Column, answer: Column) -> Column:
    name = C.def_name(prompt)
    code = _fixed_code(answer)
    before = F.regexp_extract(answer, "(?s)^(.*?)def ", 1)
    return first_reason(
        (name.isNull(), "prompt_without_function"),
        (~answer.contains("def "), "no_definition"),
        (trim_space(before) == "", "no_cause_line"),
        (~code.contains(F.concat(F.lit("def "), name)), _detail("function_renamed", name)),
        (C.squash_space(code) == C.squash_space(C.from_first_def(prompt)), "unchanged_code"),
    )


def gate_code_fix_static(prompt: Column, answer: Column, parses: Column) -> Column:
    """A cause line, then changed code that keeps the name and parses."""
    return first_reason(
        (_fix_shape(prompt, answer).isNotNull(), _fix_shape(prompt, answer)),
        (~parses, "does_not_parse"),
    )


def gate_value_near_name(answer: Column, truth: Column) -> Column:
    """Every recorded value must follow its name within ninety characters.

    ``truth`` is ARRAY<STRUCT<name, value>>; blanks and quote style are ignored.  The
    text is scanned once per value.
    """
    def literal(t: Column) -> Column:
        return F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

    def squash(t: Column) -> Column:
        return F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("'"), F.lit('"'))

    def flaw(said: Column, t: Column) -> Column:
        name, value = squash(trim_space(t["name"])), squash(trim_space(t["value"]))
        near = F.rlike(said, F.concat(F.lit("(?s)(?="), literal(name), F.lit(f").{{0,{V.VALUE_WINDOW}}}?"), literal(value)))
        return first_reason(
            (~said.contains(name), _detail("name_absent", t["name"])),
            (~near, _detail("value_not_near", t["name"])),
        )

    return bind(squash(answer), lambda said: _first(F.array_compact(
        F.transform(truth, lambda t: flaw(said, t)))))


# --- tool results ------------------------------------------------------------
def gate_grounded(answer: Column, stdout: Column, probe_chars: int | None = None) -> Column:
    """Every answer number must come from the tool output or round one of its values.

    An answer without numbers must repeat the first output line, of which a caller may
    ask for the first ``probe_chars`` characters only.
    """
    def read(tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.struct(
            t.alias("text"), t.try_cast("double").alias("v"), N.decimals(t).alias("d")))

    def derivable(a: Column, outs: Column) -> Column:
        scale = F.pow(F.lit(10.0), a["d"])
        return F.exists(outs, lambda o: (F.abs(o["v"] - a["v"]) < 1e-9) | (
            (o["d"] > 3) & (F.abs(F.floor(o["v"] * scale + 0.5) / scale - a["v"]) < 1e-9)))

    def judge(s: Column) -> Column:
        checked = F.transform(s["said"], lambda a: F.struct(
            a["text"].alias("text"), derivable(a, s["outs"]).alias("ok")))
        stray = F.filter(checked, lambda c: ~c["ok"] & (
            F.length(F.regexp_replace(c["text"], "^0+", "")) >= 2))
        used = F.exists(checked, lambda c: c["ok"])
        line = trim_space(F.regexp_extract(trim_space(stdout), "^([^\n]*)", 1))
        probe = line if probe_chars is None else F.substr(line, F.lit(1), F.lit(probe_chars))
        return first_reason(
            ((F.size(s["said"]) == 0) & (probe != "") & ~F.lower(answer).contains(F.lower(probe)),
             "output_not_echoed"),
            (F.size(s["said"]) == 0, F.lit(None).cast("string")),
            (F.size(stray) > 0, _detail("number_not_derivable", _first(stray)["text"])),
            (~used & (F.size(s["outs"]) > 0), "output_ignored"),
        )

    return bind(F.struct(read(N.number_tokens(answer)).alias("said"),
                         read(N.number_tokens(stdout)).alias("outs")), judge)


def gate_plausible(prompt: Column, answer: Column) -> Column:
    """Negative amounts, missing cost, one number for two questions, foreign currency."""
    low = F.lower(prompt)
    foreign = [
        (answer.contains(c) & ~prompt.contains(c) & contains_any(
            prompt, [o for o in V.CURRENCIES if o != c]), f"foreign_currency: {c}")
        for c in V.CURRENCIES
    ]
    return first_reason(
        (contains_any(low, V.AMOUNT_QUESTIONS) & answer.rlike("(?s)^[^0-9]*-[0-9]"), "negative_amount"),
        (low.contains("total cost") & ~answer.contains("$") & ~F.lower(answer).contains("cost"),
         "cost_missing"),
        ((F.regexp_count(prompt, F.lit(r"\?")) >= 2) & (F.size(N.number_tokens(answer)) == 1),
         "one_number_for_two_questions"),
        *foreign,
    )


def gate_ratio_shares(prompt: Column, answer: Column) -> Column:
    """Every share an exact ratio prompt implies must be in the answer."""
    plain = F.replace(answer, F.lit(","), F.lit(""))
    missing = F.filter(N.ratio_shares(prompt)["shares"], lambda s: ~plain.contains(s.cast("string")))
    return _detail("share_missing", _first(missing).cast("string"))


def gate_magnitude(prompt: Column, answer: Column) -> Column:
    """The largest answer number must be on the scale of the prompt's figures."""
    return bind(F.struct(N.max_number(prompt).alias("p"), N.max_number(answer).alias("a")),
                lambda m: first_reason(
        ((m["p"] >= 10000) & (m["a"] > 0) & (m["a"] < m["p"] / 20), "far_below_prompt_scale"),
        ((m["p"] >= 100) & (m["a"] > m["p"] * 5), "far_above_prompt_scale"),
    ))


def gate_list_echo(answer: Column, stdout: Column) -> Column:
    """A list on the first output line must be reproduced."""
    def squash(t: Column) -> Column:
        return F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("'"), F.lit('"'))

    line = F.regexp_extract(trim_space(stdout), "^([^\n]*)", 1)
    shown = F.regexp_extract(line, f"({V.LIST_LITERAL})", 1)
    return F.when((shown != "") & ~squash(answer).contains(squash(shown)), F.lit("list_not_echoed"))


def gate_meeting_time(prompt: Column, answer: Column) -> Column:
    """A meeting happens after both departures, before either vehicle could arrive
    alone, at a distance that fits the first vehicle's speed within two per cent."""
    def clock(group: int) -> Column:
        return F.regexp_extract(answer, V.CLOCK, group).try_cast("int")

    def judge(s: Column) -> Column:
        t, meet = s["t"], s["hh"] * 60 + s["mm"]
        solo = F.zip_with(t["departures"], t["speeds"], lambda d, v: d + F.floor(
            t["distance"] / v * 60).cast("int"))
        first_leg = F.get(t["speeds"], F.lit(0)) * (meet - F.get(t["departures"], F.lit(0))) / 60
        return first_reason(
            (t.isNull(), F.lit(None).cast("string")),
            (s["hh"].isNull(), "no_clock_time"),
            ((s["hh"] >= 24) | (s["mm"] >= 60), "malformed_clock_time"),
            ((meet <= F.array_max(t["departures"])) | (meet >= F.array_min(solo)), "outside_physical_bounds"),
            (~F.exists(N.numbers(answer), lambda v: F.abs(v - first_leg) <= t["distance"] * 0.02),
             "distance_inconsistent"),
        )

    return bind(F.struct(N.travel_facts(prompt).alias("t"), clock(1).alias("hh"), clock(2).alias("mm")), judge)


def gate_tool_answer(prompt: Column, answer: Column, stdout: Column) -> Column:
    """The checks of a tool-backed answer in order of precedence."""
    return F.coalesce(
        F.when(trim_space(stdout) == "", "no_output"),
        F.when((trim_space(answer) == "") | contains_any(answer, ["<tool_call>", "```"]), "not_plain_answer"),
        gate_grounded(answer, stdout), gate_plausible(prompt, answer),
        gate_meeting_time(prompt, answer), gate_magnitude(prompt, answer),
        gate_ratio_shares(prompt, answer), gate_list_echo(answer, stdout),
    )


# --- content and flags -------------------------------------------------------
def gate_min_content(family: Column, answer: Column) -> Column:
    """Logic answers need eight words, maths answers a digit."""
    return first_reason(
        (family.isin("logical", "logical_deductive_reasoning") & (X.word_count(answer) < 8), "too_short"),
        (family.isin("maths", "mathematical_reasoning") & ~answer.rlike("[0-9]"), "no_number"),
    )


def flag_degenerate(text: Column, max_chars: int | None = None) -> Column:
    """Empty, fence-spamming or quote-spamming output, and such of over ``max_chars`` characters.

    By default no length is too long; ``fixed.DEGENERATE_LENGTH`` suits short answers.
    """
    fence = F.regexp_count(text, F.lit("```python"))
    over_long = F.lit(False) if max_chars is None else F.length(text) > max_chars
    return (
        (trim_space(text) == "") | over_long
        | contains_any(text, ["``````", '"\n"\n"']) | (fence > 2)
    )


def flag_semantic_clue(prompt: Column) -> Column:
    """Does the prompt carry a clue outside the covered families?"""
    return contains_any(F.lower(prompt), V.OUT_OF_SCOPE_CLUES)


def strip_outside_note(answer: Column) -> Column:
    """Entity answers ship without the outside-the-inventory note."""
    cut = F.regexp_replace(answer, f"(?s){V.OUTSIDE_NOTE}.*$", "")
    return F.when(answer.contains(V.OUTSIDE_NOTE), trim_space(
        F.regexp_replace(trim_space(cut), "[;,-]+$", ""))).otherwise(answer)


# --- dispatch ----------------------------------------------------------------
GATES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "code_generation": gate_code_static,
    "code_fix": gate_code_fix_static,
    "ner": lambda p, a, _: gate_entities(p, strip_outside_note(a)),
    "sentiment": lambda p, a, _: gate_sentiment(p, a),
    "summarisation": lambda p, a, _: gate_summary(p, a),
    "factual": lambda p, a, _: gate_factual(p, a),
    "logical": lambda p, a, _: gate_min_content(F.lit("logical"), a),
    "maths": lambda p, a, _: gate_min_content(F.lit("maths"), a),
}
"""Gate of each family; callers may add their own entries."""


def gate(rows: DataFrame, prompt: str = "prompt", answer: str = "answer", family: str = "family",
         families: list[str] | None = None) -> DataFrame:
    """Add ``reason`` and ``accepted`` to rows of any mix of families.

    ``families`` limits the CASE to the families present.  Python is asked only
    for code rows that pass the cheap checks; other rows hand it NULL.
    """
    p, a, f = F.col(prompt), F.col(answer), F.col(family)
    use = list(GATES) if families is None else families
    out, parses = rows, F.lit(None).cast("boolean")
    if {"code_generation", "code_fix"} & set(use):
        pending = F.when(f == "code_generation", code_to_parse(p, a)).when(f == "code_fix", fix_to_parse(p, a))
        out = out.withColumn("__parses", C.python_parses(pending))
        parses = F.col("__parses")
    by_family = first_reason(*[(f == name, GATES[name](p, a, parses)) for name in use])
    empty = a.isNull() | (trim_space(a) == "")
    reason = F.when(empty, F.lit("empty_answer")).otherwise(by_family)
    return (out.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
            .drop("__parses"))


