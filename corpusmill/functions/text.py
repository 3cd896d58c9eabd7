"""Text functions as Columns: words, shingles, fingerprints, tags and small classifiers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

# Fixed values.
TASK_TAGS = ["translate", "sentiment", "topic", "prompt", "diacritize", "clean", "summarize", "NER", "headline", "qa", "title", "lang_ID"]
LANGUAGE_TAG = "<(yor|urh|ibo|efi|hau|eng|pcm|ff|fuv|ful)>"
PROMPT_TAG = "<(lang_ID|lang_ID_label|classify|translate|diacritize|clean|prompt|NER|qa|)>"
TOPICS = ["business", "entertainment", "health", "politics", "religion", "sports", "technology"]
DISTINCTIVE = {"yor": "ẹọṣàáèéìíòóùúẹ́ẹ̀ọ́ọ̀", "ibo": "ịọụ", "hau": "ɓɗƙ", "ewe": "ɖɣʋŋɔɛ", "twi": "ɔɛ", "aka": "ɔɛ", "fon": "ɖɛɔ"}
TAG_NAMES = {"eng": "english", "yor": "yoruba", "hau": "hausa", "ibo": "igbo", "fuv": "fulfulde", "ful": "fulah", "urh": "urhobo", "efi": "efik", "efik": "efik", "pcm": "pidgin", "ff": "fulfulde", "unk": "unknown"}
#: Parts of file names and the language each names; the longest comes first, so none hides another.
FILE_LANGUAGES = {
    "fulfulde": "fulfulde", "english": "english", "yoruba": "yoruba", "urhobo": "urhobo", "fulani": "fulah", "pidgin": "pidgin", "hausa": "hausa", "fulah": "fulah", "igbo": "igbo", "efik": "efik", "fula": "fulah",
    "yor": "yoruba", "ibo": "igbo", "fuv": "fulfulde", "ful": "fulah", "eng": "english", "urh": "urhobo", "pcm": "pidgin", "efi": "efik", "hau": "hausa",
}


def words(text: Column) -> Column:
    """Word runs of a text, as an array."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def strip_spaces(text: Column) -> Column:
    """Unicode white space off both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    return strip_spaces(F.regexp_replace(text, f"{SPACE}+", " "))


def space_words(text: Column) -> Column:
    """Runs between white space, as an array."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not again wherever the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-word shingles in lower case; fewer words make one shingle, none make none."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return let(words(F.lower(text)), of)


def fingerprint(text: Column) -> Column:
    """SHA-256 of the lower-cased text, punctuation and spacing kept."""
    return F.sha2(F.lower(text), 256)


def after_language_tag(text: Column) -> Column:
    return F.element_at(F.split(text, LANGUAGE_TAG), -1)


def language_prompt(text: Column, chars: int = 80) -> Column:
    """Start of what follows the last language tag, without task tags."""
    return strip_spaces(F.substring(F.regexp_replace(after_language_tag(text), PROMPT_TAG, ""), 1, chars))


def first_match(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest), reversed(pairs), default)


def task_of(text: Column, default: Column) -> Column:
    """First task tag of the fixed order that the text holds."""
    return first_match([(text.contains(f"<{t}>"), F.lit(t)) for t in TASK_TAGS], default)


def file_language(name: Column) -> Column:
    return first_match([(F.lower(name).contains(k), F.lit(v)) for k, v in FILE_LANGUAGES.items()], F.lit(None).cast("string"))


def tag_name(tag: Column) -> Column:
    """Language name of a tag like <yor>, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in TAG_NAMES.items() for x in (f"<{k}>", v)]), tag)


def route(name: Column, english: Column, african: Column, default: Column) -> Column:
    n = F.lower(name)
    has = lambda *parts: reduce(Column.__or__, [n.contains(p) for p in parts])
    return first_match([(has("english", "eng"), english), (has("african", "afr", "nigerian"), african)], default)


def extract_answer(text: Column) -> Column:
    """Up to and with the first lower-case ASCII letter that an upper-case one follows, else all."""
    head = F.regexp_extract(text, "(?s)^(.*?[a-z])[A-Z]", 1)
    return F.when(head != "", head).otherwise(text)


def assign_topic(text: Column) -> Column:
    """Business first; keyword rules come next, as they win over every later topic."""
    low = F.lower(text)
    rules = [("business", "business"), ("football", "sports"), ("music", "entertainment"), ("africa", "politics"), ("afrikaan", "politics")]
    return first_match([(low.contains(k), F.lit(v)) for k, v in rules + [(t, t) for t in TOPICS[1:]]], F.lit("unknown"))


def last_word(text: Column) -> Column:
    w = space_words(text)
    return F.when(F.size(w) > 0, F.element_at(w, -1))


def language_warning(text: Column, code: Column, min_length: int = 40) -> Column:
    """'empty', 'no distinctive letters' or null."""
    clean = collapse_spaces(F.coalesce(text, F.lit("")))
    missing = [((code == k) & (F.length(clean) >= min_length) & ~F.lower(clean).rlike(f"[{''.join(dict.fromkeys(v))}]"), F.lit("no distinctive letters")) for k, v in DISTINCTIVE.items()]
    return first_match([(clean == "", F.lit("empty")), *missing], F.lit(None).cast("string"))


def html_text(html: Column) -> Column:
    """Visible text of HTML: comments, scripts, styles and tags go, white space collapses."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "[ \t\r\n]+", " "))


def title(text: Column, stem: Column) -> Column:
    """First line without leading # and spaces, else the file's stem."""
    line = F.trim(F.regexp_replace(F.element_at(F.split(text, "\n"), 1), "^[# ]+", ""))
    return F.when(line != "", line).otherwise(stem)


def numbered_block(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("[chunk "), i.cast("string"), F.lit("]\n"), c)), "\n\n")


def chunk_lengths(text: Column, chars: int) -> Column:
    """Words counted slice by slice of ``chars`` characters, and summed."""
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / chars)), lambda i: F.substr(text, (i * chars + 1).cast("int"), F.lit(chars)))
    return F.aggregate(slices, F.lit(0).cast("long"), lambda acc, s: acc + F.size(words(s)))


def hash01(*parts: Column) -> Column:
    """A number in [0, 1) from the parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
