"""Column expressions over tuples: word tests, subsumption, generalised arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the pruning rules and the shared-argument variable.
PREPOSITIONS = ["in", "on", "at", "over", "by", "after", "near", "of"]
BE_VERBS = ["be", "is", "was", "are", "were"]
HAVE_VERBS = ["has", "have", "had", "having"]
REPORTING_VERBS = ["say", "said", "saying", "tell", "told", "speak", "spoke"]
PRONOUNS = ["he", "she", "they", "it", "i", "we"]
XVAR = "XVAR"


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def tokens(text: Column) -> Column:
    """Blank-separated tokens; blanks at the end make none."""
    return F.split(F.rtrim(text), " ")


def has_alphanumeric(text: Column) -> Column:
    return text.rlike("[a-zA-Z0-9]")


def starts_alphanumeric(text: Column) -> Column:
    return F.coalesce(text.rlike("^[a-zA-Z0-9]"), F.lit(False))


def canonical_verbs(text: Column) -> Column:
    """Forms of *have* become ``had``, forms of *be* become ``be``, token by token."""
    word = lambda w: F.when(w.isin(HAVE_VERBS), "had").when(w.isin(BE_VERBS), "be").otherwise(w)
    return F.array_join(F.transform(tokens(text), word), " ")


def canonical_be(text: Column) -> Column:
    return F.array_join(F.transform(tokens(text), lambda w: F.when(w.isin(BE_VERBS), "be").otherwise(w)), " ")


def is_reporting(rel: Column) -> Column:
    return F.arrays_overlap(tokens(rel), strings(REPORTING_VERBS))


def is_be_or_had(rel: Column) -> Column:
    return rel.isin("be", "had", "had had")


def inferred_preposition(rel: Column, sentence: Column) -> Column:
    """The relation's first preposition isn't a token of the sentence."""
    first = F.get(F.filter(tokens(rel), lambda w: w.isin(PREPOSITIONS)), F.lit(0))
    return F.when(first.isNull(), False).otherwise(F.coalesce(~F.array_contains(tokens(sentence), first), F.lit(False)))  # few sentences are cut


def clean_relation(rel: Column) -> Column:
    return F.regexp_replace(rel, "^be ", "")


def tuple_text(arg1: Column, rel: Column, arg2: Column) -> Column:
    return F.concat_ws(" ", arg1, clean_relation(rel), arg2)


def same_arguments(o: str | Column, i: str | Column, fold: bool) -> Column:
    """Equal or switched arguments of two records, as structs or by their aliases; ``fold`` ignores case."""
    text = (lambda a, c: F.lower(_field(a, c)["text"])) if fold else (lambda a, c: _field(a, c)["text"])
    same = (text(o, "arg1") == text(i, "arg1")) & (text(o, "arg2") == text(i, "arg2"))
    return same | ((text(o, "arg1") == text(i, "arg2")) & (text(o, "arg2") == text(i, "arg1")))


def span_inside(a: Column, b: Column) -> Column:
    return (a["start"] >= b["start"]) & (a["end"] <= b["end"])


def _field(r: str | Column, c: str) -> Column:
    """A field of a record that is a struct or an alias."""
    return F.col(f"{r}.{c}") if isinstance(r, str) else r[c]


def spans_subsume(a: str | Column, b: str | Column) -> Column:
    """Each span of ``b`` lies in that of ``a``."""
    return reduce(Column.__and__, (span_inside(_field(b, c), _field(a, c)) for c in ("arg1", "rel", "arg2")))


def said_columns() -> dict[str, Column]:
    """What ``subsume_each_other`` needs of a record, made once for each: its text, and that text's words without ``be``."""
    said = tuple_text(*(F.col(f"{c}.text") for c in ("arg1", "rel", "arg2")))
    return {"said": said, "words_said": F.array_remove(F.array_distinct(tokens(said)), "be")}


def words_nest(x: Column, y: Column) -> Column:
    """One list's words are all among the other's. Words are distinct; most lists differ by the first word, which is looked for alone."""
    inside = lambda a, b: (F.size(a) <= F.size(b)) & F.coalesce(F.array_contains(b, F.get(a, F.lit(0))), F.lit(True)) & (F.size(F.array_except(a, b)) == 0)
    return inside(x, y) | inside(y, x)


def subsume_each_other(o: str | Column, i: str | Column) -> Column:
    """Of two records with their ``said_columns``, as aliases or as structs."""
    (a, x), (b, y) = ((_field(r, "said"), _field(r, "words_said")) for r in (o, i))
    return spans_subsume(o, i) | spans_subsume(i, o) | a.contains(b) | b.contains(a) | words_nest(x, y)


def argument_forms(head: Column, types: Column) -> Column:
    """The small-letter set of head and types, without blanks; a unit or period of time drops ``type:number``."""
    every = F.concat(F.array(head), F.coalesce(types, F.array().cast("array<string>")))
    forms = F.array_distinct(F.filter(F.transform(every, F.lower), lambda x: F.trim(x) != ""))
    timed = lambda x: F.arrays_overlap(x, strings(["type:time_unit", "type:time_period"]))
    return F.get(F.transform(F.array(forms), lambda x: F.when(timed(x), F.array_remove(x, "type:number")).otherwise(x)), F.lit(0))  # the list is made once


def shared_form(is_shared: Column, form: Column) -> Column:
    """A shared argument becomes the variable, with the type if the form is one."""
    typed = form.startswith("type:") | form.startswith("Type:")
    return F.when(is_shared & typed, F.concat(F.lit(XVAR + ":"), form)).when(is_shared, F.lit(XVAR)).otherwise(form)


def _may_be_typed(arg: Column) -> Column:
    """Has two ``:`` at least, without which it isn't taken apart."""
    return F.coalesce(F.substring_index(arg, ":", 2) != arg, F.lit(False))


def variable_type(arg: Column) -> Column:
    """The type name of a typed variable (three parts by ``:``, the middle one ``type``); else null."""
    parts = F.split(F.regexp_replace(arg, ":+$", ""), ":")
    named = F.transform(F.array(parts), lambda p: F.when((F.size(p) == 3) & (F.lower(F.get(p, F.lit(1))) == "type"), F.get(p, F.lit(2))))  # parts are made once
    return F.when(_may_be_typed(arg), F.get(named, F.lit(0)))


def side_type(a: Column, b: Column) -> Column:
    return F.coalesce(variable_type(a), variable_type(b))


def types_compatible(f1: Column, f2: Column, s1: Column, s2: Column) -> Column:
    """The sides' variables have the same type, or one side has none. A type named ``NA`` counts as none."""
    f, s = (F.coalesce(side_type(*x), F.lit("NA")) for x in ((f1, f2), (s1, s2)))
    alike = F.exists(F.array(F.struct(f.alias("f"), s.alias("s"))), lambda t: (t["f"] == "NA") | (t["s"] == "NA") | (t["f"] == t["s"]))
    return ~((_may_be_typed(f1) | _may_be_typed(f2)) & (_may_be_typed(s1) | _may_be_typed(s2))) | alike


def type_name(text: Column) -> Column:
    """What follows ``type:``, without ``:Number``; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(text, "^(?s)(.*?)[tT]ype:(.*)$", 2), ":Number", "")


def is_typed(text: Column) -> Column:
    return text.rlike("(?s)^(.*?)[tT]ype:(.*)$")


def display_type(text: Column) -> Column:
    """``prefix[type name]`` for a typed argument."""
    prefix = F.regexp_extract(text, "^(?s)(.*?)[tT]ype:(.*)$", 1)
    return F.when(is_typed(text), F.concat(prefix, F.lit("["), type_name(text), F.lit("]"))).otherwise(text)


def display_argument(text: Column) -> Column:
    return F.regexp_replace(display_type(text), XVAR, "X")
