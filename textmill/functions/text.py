"""Text functions as Column expressions. They stay in the JVM; none is a Python UDF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The combining marks that a word may hold and that drop out of it.
MARKS = "".join(map(chr, (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331)))


def _folded(letter: str) -> str:
    """What a lower-case letter folds to: a Latin one to itself without marks, others to the form that is compared without case."""
    plain = letter.casefold() if len(letter.casefold()) == 1 else letter
    base, *marks = unicodedata.normalize("NFD", plain)
    return base if marks and base.isascii() and base.isalpha() and all(unicodedata.category(m) == "Mn" for m in marks) else plain


#: Lower-case letters that fold to others, and these. Beyond the range there are none.
_FOLDS = {c: _folded(c) for c in map(chr, range(0x80, 0x2100)) if c.isalpha() and c == c.lower() and _folded(c) != c}
ACCENTED, FOLDED = "".join(_FOLDS), "".join(_FOLDS.values())

#: White space, as Python has it. Java and RE2 both read the pattern.
WHITE = r"[\s\x0b\x1c-\x1f\x85\pZ]+"

# Vowels that a stem loses at its end.
FINAL_VOWELS = "aeiouàèéìòóù"

# What is dropped or spaced out before words are compared.
TIMESTAMP = r"\[\d{2}:\d{2}:\d{2}\]"
UNCERTAIN = r"\[\?|\?\]"
APOSTROPHES = "['’`]"

# Where sentences end; where points of an answer end, which abbreviations don't; marks that begin its items.
SENTENCE_END = r"[.!?]+(?=\s|$)"
POINT_END = r"[.!?]+(?=\s+(?![a-zà-öø-ÿ\d])|\s*$)"
LINE_ITEM = r"(?:^|\n)\s*\d{1,2}[.)]\s+"
FIRST_ITEM = r"^\s*1[.)]\s+"
INLINE_ITEM = r"(?<=[.!?;])\s+\d{1,2}[.)]\s+(?=[A-ZÀ-Ý])"

# Structure that OCR writes as LaTeX.
LATEX_HEADING = r"\\(?:sub)*section\*?\{([^{}]*)\}"
LATEX_LIST = r"(?m)^[ \t]*\\(?:begin|end)\{(?:itemize|enumerate)\}[ \t]*\n?"
LATEX_ITEM = r"(?m)^[ \t]*\\item\b[ \t]*"

# Controls that change the direction of text; punctuation before and after a word's body.
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
WORD_PARTS = r"""(?s)^(\s*)(["'’“«(\[¿]*)(.+?)(["”».,;:!?)\]…]*)$"""

# What is put before texts for families of embedding models.
PROMPTS = {
    "qwen3-embedding": ("Instruct: Given a question, retrieve relevant passages that answer it\nQuery:", ""),
    "embeddinggemma": ("task: search result | query: ", "title: none | text: "),
    "bge-m3": ("", ""),
}

# Marks around matches, from the private use area.
BEFORE, AFTER = "\ue000", "\ue001"

# Shapes of keys.
KEY_PATTERNS = (
    "sk-proj-[A-Za-z0-9_-]{16,}",
    "sk-ant-[A-Za-z0-9_-]{16,}",
    "sk-[A-Za-z0-9_-]{16,}",
    "gsk_[A-Za-z0-9_-]{16,}",
    "AIza[A-Za-z0-9_-]{16,}",
)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED + MARKS, FOLDED)  # marks have no counterpart, so they drop out


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits (and private characters) of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def stem(word: Column) -> Column:
    """Words of five letters or more lose the vowels at their end."""
    return F.when(F.length(word) >= 5, F.regexp_replace(word, f"[{FINAL_VOWELS}]+$", "")).otherwise(word)


def estimate_tokens(text: Column, per_word: float = 2.29) -> Column:
    return F.ceil(word_count(text) * per_word).cast("long")


def word_budget(context: Column, prompt: Column, reply: Column, per_word: float = 2.29, reserve: int = 512, least: int = 200) -> Column:
    """Words that fit beside prompt and reply, `least` at least."""
    return F.greatest(F.lit(least), F.floor(F.greatest(F.lit(0), context - prompt - reply - reserve) / per_word)).cast("long")


def timestamp(seconds: Column) -> Column:
    """hh:mm:ss."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))


def comparable(text: Column) -> Column:
    """For word error rates: without marks and punctuation, lower case, accents kept."""
    text = F.regexp_replace(F.regexp_replace(text, TIMESTAMP, " "), UNCERTAIN, "")
    text = F.regexp_replace(F.lower(text), APOSTROPHES, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def label(text: Column) -> Column:
    """Spaces collapsed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(text, WHITE, " ")), F.lit(""))


def effective_label(first: Column, second: Column) -> Column:
    return F.coalesce(label(first), label(second))


def label_key(text: Column) -> Column:
    return F.coalesce(F.lower(label(text)), F.lit(""))


def joined_hyphens(text: Column) -> Column:
    """Words that a line's end cut in two, whole again."""
    return F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def redact(text: Column, secrets: tuple[str, ...] = (), patterns: tuple[str, ...] = KEY_PATTERNS) -> Column:
    """Known secrets and what looks like a key, as ***."""
    for secret in secrets:
        text = F.replace(text, F.lit(secret), F.lit("***"))
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "***")
    return text


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def revision(text: Column) -> Column:
    return F.substring(content_hash(text), 1, 16)


def concept_key(job: Column, source: Column, term: Column) -> Column:
    return F.sha2(F.concat_ws(":", job, source, F.lower(F.trim(term))), 256)


def sentences(text: Column) -> Column:
    """Cut at runs of . ! ? before white space or the end."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def title(text: Column, length: int = 60) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))).otherwise(text)


def marked(text: Column, pattern: str, before: str = BEFORE, after: str = AFTER) -> Column:
    """Matches of the pattern between two marks."""
    return F.regexp_replace(text, pattern, f"{before}$0{after}")


def marked_parts(text: Column, before: str = BEFORE, after: str = AFTER) -> Column:
    """Array of (text, match) from marked()."""
    parts = F.filter(F.split(text, f"(?={before})|(?<={after})"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.translate(p, before + after, "").alias("text"), p.startswith(before).alias("match")))


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_markdown(text: Column) -> Column:
    """On one line, with HTML and Markdown signs escaped."""
    return F.regexp_replace(escape_html(F.trim(F.regexp_replace(text, r"\s+", " "))), r"([\\`*_{}\[\]()#+.!|>~-])", r"\\$1")


def without_latex_structure(text: Column) -> Column:
    """Headings as their text, lists without their frame, items as dashes."""
    text = F.regexp_replace(F.regexp_replace(text, LATEX_HEADING, "$1"), LATEX_LIST, "")
    return F.rtrim(F.regexp_replace(text, LATEX_ITEM, "- "), F.lit("\n"))


def formulas(text: Column) -> Column:
    """What stands between \\( and \\) or \\[ and \\]. An opener that isn't closed, or is opened again before, is text."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(\\\((?:(?!\\[()]).)*\\\)|\\\[(?:(?!\\[\[\]]).)*\\\])"), 1)
    return F.transform(found, lambda x: F.substring(x, F.lit(3), F.length(x) - 4))


def doubtful(word: Column) -> Column:
    """The word's body between [? and ?]."""
    return F.regexp_replace(word, WORD_PARTS, "$1$2[?$3?]$4")


def corrected(word: Column, heard: Column) -> Column:
    """The word's body, and what was heard in its place above it."""
    part = lambda n: F.regexp_extract(word, WORD_PARTS, n)
    whole = F.concat(part(1), part(2), part(3), F.lit("<sup>"), F.replace(F.replace(escape_html(heard), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")), F.lit("</sup>"), part(4))
    return F.when(word.rlike(WORD_PARTS), whole).otherwise(word)


def visible_label(text: Column, length: int = 100) -> Column:
    """An untrusted label without control and direction characters; null if nothing is left or it is longer than `length`."""
    clean = label(F.translate(F.regexp_replace(F.regexp_replace(text, r"\s", " "), r"\p{Cc}", ""), BIDI, ""))
    return F.when(F.length(clean) <= length, clean)


def prompted(text: Column, model: Column, query: bool) -> Column:
    """A question or a document as its family of embedding models wants it; of other families as it is."""
    out = text
    for family, (question, document) in PROMPTS.items():
        out = F.when(model.startswith(family), F.concat(F.lit(question if query else document), text)).otherwise(out)
    return out


def clean_name(name: Column, length: int = 100) -> Column:
    """File name without control characters, cut before its suffix."""
    name = F.regexp_replace(name, r"[\p{Cc}/\\]", "")
    suffix = F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,10})$", 1)
    stem_ = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.concat(F.substring(stem_, F.lit(1), F.lit(length) - F.length(suffix)), suffix)


def exact_terms(text: Column) -> Column:
    """Numbers, and capitalised words that don't begin the text."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(found, lambda w, i: w.rlike(r"\d") | ((i > 0) & w.rlike(r"^\p{Lu}")))


def content_words(text: Column, stopwords: tuple[str, ...]) -> Column:
    return F.array_except(tokens(text), F.array(*map(F.lit, stopwords)))


def contains_tokens(text_tokens: Column, quote_tokens: Column) -> Column:
    """Whether the second array stands in the first one in a row."""
    spaced = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(quote_tokens) > 0) & F.contains(spaced(text_tokens), spaced(quote_tokens))


def token_place(text_tokens: Column, quote_tokens: Column) -> Column:
    """Place (from 0) of the first token of the second array where it stands in the first one in a row; null if it doesn't."""
    spaced = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    before = F.substring(spaced(text_tokens), F.lit(1), F.instr(spaced(text_tokens), spaced(quote_tokens)) - 1)
    return F.when(contains_tokens(text_tokens, quote_tokens), F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))))


def quote_length(quote_tokens: Column, least: int = 3, most: int = 40) -> Column:
    return F.size(quote_tokens).between(least, most)
