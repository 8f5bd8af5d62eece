"""Column functions on text, hashes, JSON, dates and numbers: Spark's own expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a question's intent.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "find", "for", "from", "if", "in", "into", "is", "of", "on", "or", "that", "the", "to", "what", "which", "with")
# Accepted names of question types.
TYPE_NAMES = {
    "SCQ": ("SCQ", "SINGLE", "SINGLE CHOICE", "SINGLE CORRECT"),
    "MCQ": ("MCQ", "MCQS", "MSQ", "MULTIPLE CHOICE", "MULTIPLE CORRECT", "MULTIPLE SELECT"),
    "INTEGER": ("INTEGER", "INT", "NAT"),
    "NUMERIC": ("NUMERIC", "NUMERICAL", "NUM"),
}
# Short names of subjects.
SUBJECT_NAMES = {
    "PHYSICS": ("PHY", "PHYY", "PH"),
    "CHEMISTRY": ("CHEM", "CHM", "CH"),
    "MATHEMATICS": ("MATH", "MATHS", "MAT", "MA"),
    "BIOLOGY": ("BIO", "BIOL", "BI"),
}

# Patterns that decide which texts have equal hashes.
NOT_LETTERS = r"[^a-z0-9\p{L}\p{N}]+"  # ASCII first: asking for a category is slow
NOT_ASCII_LETTERS = r"[^a-z0-9]+"
NUMBER_LABEL = r"(?U)^\s*+[\(\[]?\d+[\)\.\]]"
FORTY_CHARS = r"(?Us)^\s*+\S.{38}.*?\S"  # from the first sign to the last
OPTION_LABEL = r"(?U)^[\(\[]?[a-z][\)\.\]]\s*"
WHITE_SPACE = r"(?U)\s+"
START_CHARS = 300  # in which an intent's words are looked for first
# What a numbered question looks like in page text, and how long a block of one is at least.
NUMBERED = r"(?m)(\(\d+\)|^\d+[\.\)])"
BLOCK_START = r"\n(?=\d+[\.\)])"
BLOCK_CHARS = 20
# Patterns that cut JSON out of a response and mend it.
JSON_ARRAY = r"(?s)\[\s*\{.*\}\s*\]"
JSON_OBJECT = r'(?s)\{\s*".*\}\s*'
STRAY_BACKSLASH = r"""(?<!\\)\\(?![\\/bfnrtu"'])"""
COMMA_BEFORE_BRACKET, COMMA_BEFORE_BRACE = r",\s*\]", r",\s*\}"


def python_strip(c: Column) -> Column:
    """Without white space of any kind at both ends; each run of it is looked at once, however long."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def filled_or(c: Column, default) -> Column:
    """The text, or the default if it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded share in hundredths, half up; 0 of nothing."""
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(F.lit(0).cast("long"))


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), NOT_LETTERS, "")


def spaced(c: Column) -> Column:
    """The tokens of a text, parted by one blank. Hashes and anchors can be had from it, so a text is searched once."""
    return F.trim(F.regexp_replace(F.lower(c), NOT_ASCII_LETTERS, " "))


def _joined(words: Column) -> Column:
    return F.replace(words, F.lit(" "), F.lit(""))


def content_hash(text: Column, options: Column, words: Column | None = None) -> Column:
    """Signature of a question and its options whatever their order, case and signs; empty for an empty text. ``words``:
    ``spaced`` of the text, which has all letters of a text in ASCII."""
    body = letters(text) if words is None else F.when(F.octet_length(text) == F.length(text), _joined(words)).otherwise(letters(text))
    own = F.array_sort(F.transform(F.filter(options, lambda v: F.length(v) > 0), letters))
    return F.when(F.coalesce(F.length(text) > 0, F.lit(False)), F.sha2(F.concat(body, F.lit("#"), F.coalesce(F.array_join(own, "|"), F.lit(""))), 256)).otherwise(F.lit(""))


def _loose(c: Column, label: str) -> Column:
    return F.regexp_replace(F.regexp_replace(python_strip(F.lower(c)), label, ""), NOT_ASCII_LETTERS, "")


def guard_hash(text: Column, options: Column, words: Column | None = None) -> Column:
    """A looser signature: ASCII letters and digits, without a leading number or option labels. ``words``: ``spaced`` of the
    text."""
    own = F.transform(F.filter(options, lambda v: F.length(v) > 0), lambda v: _loose(v, OPTION_LABEL))
    own = F.array_sort(F.filter(own, lambda v: F.length(v) > 0))
    label = F.length(F.regexp_replace(F.regexp_extract(text, NUMBER_LABEL, 0), NOT_ASCII_LETTERS, ""))  # of what stays of it
    rest = F.substr(_joined(spaced(text) if words is None else words), label + 1)
    body = F.concat(rest, F.lit("#"), F.coalesce(F.array_join(own, "|"), F.lit("")))
    return F.when(F.coalesce(F.length(text) > 0, F.lit(False)), F.sha2(body, 256)).otherwise(F.lit(""))


def page_hash(subject: Column, section: Column, text: Column) -> Column:
    return F.sha2(F.concat(filled_or(subject, "General"), filled_or(section, "Main"), F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")), 256)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def anchor_text(text: Column, options: Column, words: Column | None = None) -> Column:
    """The tokens of a question and its options, parted by one blank. ``words``: ``spaced`` of the text."""
    own = F.array_join(F.filter(options, lambda v: F.length(v) > 0), " ")
    return F.trim(F.concat_ws(" ", spaced(text) if words is None else words, spaced(own)))


def _core(tokens: Column) -> Column:
    return F.slice(F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS) & ~t.rlike("^[0-9]+$")), 1, 8)


def intent_signature(text: Column, subject: Column, kind: Column) -> Column:
    """Subject, type and the first eight telling words. Where the start of a text has them, the rest isn't searched; the last
    token there may be cut and doesn't count."""
    start = tokenize(F.left(text, F.lit(START_CHARS)))
    early = _core(F.slice(start, F.lit(1), F.greatest(F.size(start) - 1, F.lit(0))))
    core = F.when(F.size(early) == 8, early).otherwise(_core(tokenize(text)))
    return F.concat_ws("|", F.lower(F.coalesce(subject, F.lit(""))), F.lower(F.coalesce(kind, F.lit(""))), F.array_join(core, " "))


def word_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two arrays of tokens; 0 if either is empty."""
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def confidence_score(text: Column, n_options: Column, subject: Column, section: Column, number: Column, visual: Column, bbox: Column) -> Column:
    point = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    total = (
        F.lit(0.35) + point(text.rlike(FORTY_CHARS), 0.2) + point((F.length(subject) > 0) & (F.length(section) > 0), 0.1) + point(number.isNotNull(), 0.1)
        + point(n_options >= 2, 0.1) + point(visual, 0.05) + point(bbox, 0.1)
    )
    return F.least(F.lit(1.0), F.round(total, 3))


def _renamed(value: Column, names: dict[str, tuple[str, ...]]) -> Column:
    out = F.when(F.lit(False), value)
    for name, own in names.items():
        out = out.when(value.isin(*own), name)
    return out.otherwise(value)


def normalize_question_type(c: Column) -> Column:
    return _renamed(F.nullif(F.upper(python_strip(F.regexp_replace(c, "[_-]+", " "))), F.lit("")), TYPE_NAMES)


def resolve_question_type(planned: Column, own: Column, has_options: Column) -> Column:
    return F.coalesce(normalize_question_type(planned), normalize_question_type(own), F.when(has_options, "SCQ").otherwise("NUMERIC"))


def canonical_subject(c: Column) -> Column:
    return _renamed(F.upper(python_strip(F.coalesce(c, F.lit("")))), SUBJECT_NAMES)


def title_case(c: Column) -> Column:
    """Every run of cased letters with a capital first and small letters after it, whatever stands between the runs."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


def subject_key(c: Column) -> Column:
    return title_case(python_strip(filled_or(c, "General")))


def section_key(c: Column) -> Column:
    return F.lower(python_strip(filled_or(c, "Section A")))


def clean_page_text(c: Column) -> Column:
    """Control, format, unassigned and odd space characters become spaces; trailing blanks and empty lines shrink."""
    shown = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^\n\t ]]", " ")
    return python_strip(F.regexp_replace(F.regexp_replace(shown, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def has_numbered_questions(c: Column) -> Column:
    return F.coalesce(c.rlike(NUMBERED), F.lit(False))


def question_blocks(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, BLOCK_START), python_strip), lambda b: F.length(b) > BLOCK_CHARS)


def strip_code_fence(c: Column) -> Column:
    """What a fenced block holds, a json one first; else the text."""
    fence = lambda mark: F.split_part(F.element_at(F.split(c, mark, 2), 2), F.lit("```"), F.lit(1))
    return python_strip(F.when(c.contains("```json"), fence("```json")).when(c.contains("```"), fence("```")).otherwise(c))


def repaired_json(c: Column) -> Column:
    """JSON text cut out of prose, with stray backslashes doubled and trailing commas dropped; a cut-off array is
    closed. Null where nothing parses."""
    text = python_strip(c)
    array, single = F.regexp_extract(text, JSON_ARRAY, 0), F.regexp_extract(text, JSON_OBJECT, 0)
    target = F.when(array != "", array).when(single != "", single).otherwise(text)
    target = F.regexp_replace(target, STRAY_BACKSLASH, r"\\\\")
    target = F.regexp_replace(F.regexp_replace(target, COMMA_BEFORE_BRACKET, "]"), COMMA_BEFORE_BRACE, "}")
    closed = F.concat(target, F.lit("]"))
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(valid(target), target).when(target.startswith("[") & valid(closed), closed)


def score_percentage(score: Column, most: Column) -> Column:
    return F.concat(F.when(most > 0, F.round(score / most * 100, 2)).otherwise(F.lit(0.0)).cast("string"), F.lit("%"))


def minutes_between(start: Column, end: Column) -> Column:
    return F.coalesce(F.round(F.timestamp_diff("MICROSECOND", start, end) / 6e7, 2), F.lit(0.0))


def premium_expiry(grade: Column, now: Column) -> Column:
    """End of the next March (grade 11) or May (grade 12); a year on for other grades."""
    ends = lambda month: F.make_timestamp_ntz(F.year(now) + F.when(F.month(now) > month, 1).otherwise(0), F.lit(month), F.lit(31), F.lit(23), F.lit(59), F.lit(59))
    return F.when(grade == 11, ends(3)).when(grade == 12, ends(5)).otherwise(now + F.expr("INTERVAL 365 DAYS"))


def initials(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.slice(F.split(name, " "), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def first_name(name: Column) -> Column:
    return filled_or(F.split_part(name, F.lit(" "), F.lit(1)), "Student")


def format_seconds(s: Column) -> tuple[Column, Column]:
    """("Xm Ys", "X:YY")."""
    m, rest = F.floor(s / 60).cast("string"), (s % 60).cast("string")
    return F.concat(m, F.lit("m "), rest, F.lit("s")), F.concat(m, F.lit(":"), F.lpad(rest, 2, "0"))


def expand_bbox(box: Column, page: Column, ratio: float = 0.14, least: float = 18.0) -> Column:
    """A box with a margin of a share of its sides, at least so wide, inside the page."""
    pad_x = F.greatest(F.lit(least), F.greatest(F.lit(1.0), box["x1"] - box["x0"]) * ratio)
    pad_y = F.greatest(F.lit(least), F.greatest(F.lit(1.0), box["y1"] - box["y0"]) * ratio)
    return F.struct(
        F.greatest(page["x0"], box["x0"] - pad_x).alias("x0"), F.greatest(page["y0"], box["y0"] - pad_y).alias("y0"),
        F.least(page["x1"], box["x1"] + pad_x).alias("x1"), F.least(page["y1"], box["y1"] + pad_y).alias("y1"),
    )
