"""Text functions as Columns: everything stays inside generated code unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that mean "no value" (fixed values: the default list of pandas, and "na").
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "na"]
#: Labels that stand for a missing answer: what they hold anywhere, and what they are in full (fixed values).
SENTINEL_PARTS = ["missing", "prefer not", "not applicable", "do not know", "don't know", "dont know", "refused", "not asked", "declined"]
SENTINEL_WORDS = ["unknown", "n/a", "na", "no answer", "dk", "nk", "not sure", "refuse", "none available"]
SENTINEL = f"({'|'.join(SENTINEL_PARTS)})|^({'|'.join(SENTINEL_WORDS)})$"
#: Instructions of questionnaires that say nothing about the concept (fixed values).
BOILERPLATE = [
    "read if necessary", "do not read", "read out", "read all that apply", "select all that apply", "check all that apply", "mark all that apply",
    "choose all that apply", "select one", "if necessary", "for office use only", "office use only", "see instructions", "please specify",
]
#: Words of questions and names that ask for open text, and data types that hold it (fixed values).
OPEN_TEXT = r"specify|describe|free[\s_-]?text|please list|elaborat|in your own words"
TEXT_TYPES = ["text", "string", "char", "character", "free text"]


def null_if_na(cell: Column) -> Column:
    """Trimmed cell; null where it holds nothing or an NA token."""
    t = F.trim(cell)
    return F.when(t.isin(NA_TOKENS), F.lit(None)).otherwise(t)


def first_value(*cells: Column) -> Column:
    return F.coalesce(*(null_if_na(c) for c in cells))


def squeeze(text: Column) -> Column:
    """Runs of white space (all of Unicode's) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f", "''''\"\"\"\"")


#: Tags that are taken out; other signs in angle brackets, as <OR> or <50, stay (fixed values).
TAGS = "p|br|div|span|table|thead|tbody|tfoot|tr|td|th|ul|ol|li|dl|dt|dd|b|i|u|em|strong|a|h[1-6]|hr|img|sup|sub|blockquote|pre|code|small|font|center|caption|colgroup|col"
#: Entities that are decoded without Python. The ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&#34;": '"', "&deg;": "°", "&ndash;": "–", "&mdash;": "—", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&micro;": "µ", "&plusmn;": "±", "&times;": "×", "&ge;": "≥", "&le;": "≤", "&hellip;": "…", "&amp;": "&"}
#: A question in quotes behind an introduction that says "question", up to a tag or the end; or in quotes from the start, up to a tag.
PREAMBLE = "(?is)^[^\"“”]{0,80}?\\bquestions?\\b\\s*:?\\s*[\"“”'](.*?)[\"“”']\\s*(?:<.*)?$"
QUOTED = "(?is)^\\s*[\"“”'](.*?)[\"“”']\\s*<.*$"


def decode_entities(text: Column) -> Column:
    """The entities of ``ENTITIES`` and decimal ones of ASCII signs as what they stand for."""
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def unwrap_question(text: Column) -> Column:
    """The question in quotes behind an introduction of an instrument, without what follows it."""
    return F.when(text.rlike(PREAMBLE), F.regexp_extract(text, PREAMBLE, 1)).when(text.rlike(QUOTED), F.regexp_extract(text, QUOTED, 1)).otherwise(text)


def strip_tags(text: Column) -> Column:
    """Script and style with their content, and tags of a known list, as a blank each."""
    t = F.regexp_replace(text, r"(?is)<(script|style|head)\b[^>]*>.*?</(script|style|head)>", " ")
    return F.regexp_replace(t, rf"(?i)</?(?:{TAGS})\b[^>]*>", " ")


def strip_markup(text: Column) -> Column:
    """A page's text: tags gone, entities decoded."""
    return decode_entities(strip_tags(text))


def clean(text: Column, boilerplate: bool = False) -> Column:
    """The whole chain: entities, question out of its wrapping, tags, on demand instructions, white space. Empty for null."""
    t = strip_tags(unwrap_question(decode_entities(F.coalesce(text, F.lit("")))))
    if boilerplate:
        t = F.regexp_replace(t, f"(?i){'|'.join(BOILERPLATE)}", " ")
    return squeeze(t)


def clean_or_keep(text: Column) -> Column:
    """As ``clean``, but a text that it would blank stays as it was."""
    out = clean(text)
    return F.when(out != "", out).otherwise(text)


def words_of_name(name: Column) -> Column:
    """Parts of an identifier, lower case: snake, kebab, dotted and camel spellings."""
    t = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(t, r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case runs of a-z and 0-9 of at least ``least`` characters."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def is_sentinel(label: Column) -> Column:
    """Whether a label is empty or stands for a missing answer, anywhere in it or as a whole."""
    return F.coalesce(F.lower(F.trim(label)).rlike(SENTINEL) | (F.trim(label) == ""), F.lit(True))


def encoding_label(part: Column) -> Column:
    """The label of one ``code=label`` or ``code, label``."""
    return F.trim(F.when(F.contains(part, F.lit("=")), F.regexp_replace(part, "^[^=]*=", "")).when(F.contains(part, F.lit(",")), F.regexp_replace(part, "^[^,]*,", "")).otherwise(part))


def strip_sentinels(encoding: Column) -> Column:
    """Entries of ``code=label|..`` whose label stands for a missing answer removed; null where none is left."""
    parts = F.filter(F.transform(F.split(encoding, r"\|"), lambda p: F.trim(p)), lambda p: ~is_sentinel(encoding_label(p)))
    return F.nullif(F.array_join(parts, "|"), F.lit(""))


def signature(text: Column) -> Column:
    """Digits as #, other signs than letters and # as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), "[^a-z#]+", " "))


def short_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def ordered_id(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("\u001f", *parts)), 1, length)


def set_id(keys: Column) -> Column:
    """An id of a set of keys that doesn't depend on their order."""
    return F.concat(F.lit("c"), F.substring(F.sha1(F.array_join(F.array_sort(keys), "\u001f")), 1, 12))


def looks_free_text(question: Column, label: Column, name: Column, data_type: Column, n_options: Column) -> Column:
    """Open text: question, label or name say so, or a text type has no options."""
    said = F.concat_ws(" ", question, label)
    open_type = F.lower(F.trim(F.coalesce(data_type, F.lit("")))).isin(TEXT_TYPES) & (F.coalesce(n_options, F.lit(0)) == 0)
    return F.lower(said).rlike(OPEN_TEXT) | F.coalesce(F.lower(name).rlike(OPEN_TEXT), F.lit(False)) | open_type
