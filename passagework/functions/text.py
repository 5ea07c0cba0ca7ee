"""Text expressions: terms, headers, keys and replies; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and patterns below must equal those of the behaviour that is reproduced.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can "
    "did do does doing down during each few for from further had has have having he her here hers herself him himself his how i "
    "if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out "
    "over own same she should so some such than that the their theirs them themselves then there these they this those through "
    "to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()
ABSTAIN = "insufficient information"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
POSSESSIVE = r"['’]s\b"
TERM = r"[\p{L}\p{N}]+"
BULLET = r"^\s*(?:[-*•]+|\(?\d+[.):]|[Qq]\d+[.):])\s*"
LABEL = r"(?i)^(?:(?:rewritten|search|sub)[- ]?)?(?:query|question|passage|phrasing)\s*\d*\s*:\s*"
QUOTES = "\"'“”‘’`"


def terms(text: Column, stopwords: bool = False) -> Column:
    """Lower-cased words without possessive endings, in order and with repeats; a null text has none."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), POSSESSIVE, ""), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS)) if stopwords else found


def long_date(stamp: Column) -> Column:
    return F.date_format(stamp, "MMMM d, yyyy")


def header(title: Column, source: Column, stamp: Column) -> Column:
    """``Title. Source, Month D, YYYY.`` from what there is; empty if nothing."""
    where = F.nullif(F.concat_ws(", ", F.nullif(source, F.lit("")), long_date(stamp)), F.lit(""))
    return F.concat_ws(" ", F.concat(F.nullif(title, F.lit("")), F.lit(".")), F.concat(where, F.lit(".")))


def prompt_header(title: Column, source: Column, stamp: Column) -> Column:
    """As ``header``, without a second mark after a title that ends in one."""
    own = F.nullif(title, F.lit(""))
    marked = F.when(F.substring(own, -1, 1).isin(".", "?", "!"), own).otherwise(F.concat(own, F.lit(".")))
    where = F.nullif(F.concat_ws(", ", F.nullif(source, F.lit("")), long_date(stamp)), F.lit(""))
    return F.concat_ws(" ", marked, F.concat(where, F.lit(".")))


def passage_text(text: Column, line: Column) -> Column:
    """What a reranker reads: the header's line, if it is not empty, above the text."""
    return F.when(F.coalesce(line, F.lit("")) == "", text).otherwise(F.concat(line, F.lit("\n"), text))


def published(text: Column) -> Column:
    """An ISO time, or null where there is none."""
    return F.try_to_timestamp(text)


def text_key(text: Column) -> Column:
    """Lower-cased with white space collapsed: equal for texts that differ in nothing else."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def normalised_answer(text: Column) -> Column:
    """Lower-cased, without ASCII punctuation and articles, white space collapsed."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def is_abstention(text: Column) -> Column:
    answer = normalised_answer(text)
    return answer.startswith(ABSTAIN) | answer.endswith(ABSTAIN)


def match_verdict(answer: Column, reference: Column) -> Column:
    """True or false where a comparison of strings settles it, else null."""
    a, r = normalised_answer(answer), normalised_answer(reference)
    bare = a.isin("yes", "no") & (r.isin("yes", "no") | (r == ABSTAIN))
    return F.when(a == r, True).when(is_abstention(answer), is_abstention(reference)).when(bare, False)


def clean_line(line: Column) -> Column:
    """A reply's line without numbering, bullet, label or paired quotation marks."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), BULLET, ""), LABEL, ""))
    quoted = (F.length(bare) > 1) & F.lit(QUOTES).contains(F.substring(bare, 1, 1)) & F.lit(QUOTES).contains(F.substring(bare, -1, 1))
    return F.when(quoted, F.trim(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)


def verdict(reply: Column, positive: str, negative: str) -> Column:
    """The verdict in a reply's JSON object: true, false, or null if it can't be read."""
    said = F.lower(F.trim(F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.verdict")))
    return F.when(said == positive, True).when(said == negative, False)


def answer_form(answer: Column) -> Column:
    """yes/no, insufficient information, or entity."""
    a = F.lower(F.trim(answer))
    return F.when(a.isin("yes", "no"), "yes/no").when(a.startswith(ABSTAIN), "insufficient information").otherwise("entity")


def source_label(source: Column, stamp: Column, title: Column) -> Column:
    """``Source, YYYY-MM-DD: Title``."""
    return F.concat_ws(": ", F.nullif(F.concat_ws(", ", source, F.date_format(stamp, "yyyy-MM-dd")), F.lit("")), title)
