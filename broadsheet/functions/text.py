"""Column functions on text: whitespace, html cleaning, hashing, previews."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in text, not only the ASCII six.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
# The same set as a pattern: one Unicode property test per character, not a list of them.
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_WORD = r"(?U)[^\s\x1c-\x1f]+"

# Entity names of the HTML standard (those that end in ';'), from the standard library.
_ENTITY_JSON = json.dumps(
    {name[:-1]: char for name, char in html5.items() if name.endswith(";") and char != "&"}
)
_AMPERSAND = "\ue000"  # stands for a decoded '&' until all entities are done

_DROPPED_MARKUP = (
    r"(?s)<!--.*?-->"
    r"|(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>"
    r"|<[a-zA-Z/!?][^>]*>"
)
_IMAGE_LINK = r"https?://\S+\.(jpg|jpeg|png|gif|webp|svg)\S*"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(SPACES))


def blank(text: Column) -> Column:
    """True for NULL, empty and all-space text."""
    return F.coalesce(strip(text), F.lit("")) == ""


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, _SPACE_RUN, " "))


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0))


def preview(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def falsy_to_null(value: Column, empty) -> Column:
    """NULL for the "missing" value of an in-flight column ('' or 0.0)."""
    return F.nullif(value, F.lit(empty))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _code_point(number: Column) -> Column:
    legal = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    packed = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return F.when(legal, F.decode(packed, "UTF-32")).otherwise(F.lit("\ufffd"))


def _entity_char(name: Column, table: Column) -> Column:
    is_hex = F.lower(F.substring(name, 1, 2)) == "#x"
    digits = F.when(is_hex, F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).otherwise(
        F.substring(name, F.lit(2), F.length(name))
    )
    char = F.when(name.startswith("#"), _code_point(digits.try_cast("bigint"))).otherwise(
        F.try_element_at(table, name)
    )
    is_amp = (F.lower(name) == "amp") | (char == "&")
    return F.when(is_amp, F.lit(_AMPERSAND)).otherwise(char)


def decode_entities(text: Column) -> Column:
    """Decode named and numeric html entities without leaving the JVM.

    The distinct entities of a text are looked up once each and replaced in turn. Unknown
    names stay as they are, and a doubly escaped entity is decoded once.
    """
    table = F.from_json(F.lit(_ENTITY_JSON), "map<string,string>")

    def decode(raw: Column) -> Column:
        names = F.array_distinct(
            F.regexp_extract_all(raw, F.lit("&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"), F.lit(1))
        )
        done = F.aggregate(
            names,
            raw,
            lambda acc, name: let(
                F.concat(F.lit("&"), name, F.lit(";")),
                lambda entity: F.replace(acc, entity, F.coalesce(_entity_char(name, table), entity)),
            ),
        )
        return F.replace(done, F.lit(_AMPERSAND), F.lit("&"))

    return F.when(text.contains("&"), let(text, decode)).otherwise(text)


def clean_text(raw: Column) -> Column:
    """Visible text of an html fragment.

    Comments, scripts, styles and tags become spaces, entities are decoded after the
    tags are gone (so that an escaped tag stays text), links to images are dropped and
    white space is collapsed. NULL and '' give ''.
    """
    text = decode_entities(F.regexp_replace(raw, _DROPPED_MARKUP, " "))
    text = F.regexp_replace(text, _IMAGE_LINK, "")
    return F.coalesce(collapse_spaces(text), F.lit(""))


def article_hash(title: Column, url: Column, source: Column) -> Column:
    """Identity of an article within a run: sha256 of title, url and source."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, url, source)]
    return F.sha2(F.concat(*parts), 256)


def content_hash(url: Column, title: Column) -> Column:
    """Identity of a stored article: sha256 of ``url|title``."""
    return F.sha2(
        F.concat_ws("|", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))), 256
    )


def valid_image_url(url: Column) -> Column:
    """The trimmed url if it is http(s) and at most 2,048 characters, else NULL."""

    def checked(trimmed: Column) -> Column:
        usable = F.startswith(trimmed, F.lit("http://")) | F.startswith(trimmed, F.lit("https://"))
        return F.when(usable & (F.length(trimmed) <= 2048), trimmed)

    return let(strip(url), checked)


# --- Fixed values: Latin spellings of letters -----------------------------------------
_LIGATURES = (
    ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("þ", "th"), ("ð", "d"),
    ("đ", "d"), ("ł", "l"), ("ı", "i"),
)
_GREEK = (
    ("α", "a"), ("β", "b"), ("γ", "g"), ("δ", "d"), ("ε", "e"), ("ζ", "z"), ("η", "e"),
    ("θ", "th"), ("ι", "i"), ("κ", "k"), ("λ", "l"), ("μ", "m"), ("ν", "n"), ("ξ", "x"),
    ("ο", "o"), ("π", "p"), ("ρ", "r"), ("ς", "s"), ("σ", "s"), ("τ", "t"), ("υ", "u"),
    ("φ", "ph"), ("χ", "kh"), ("ψ", "ps"), ("ω", "o"),
)
_CYRILLIC = (
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("ж", "zh"),
    ("з", "z"), ("и", "i"), ("к", "k"), ("л", "l"), ("м", "m"), ("н", "n"), ("о", "o"),
    ("п", "p"), ("р", "r"), ("с", "s"), ("т", "t"), ("у", "u"), ("ф", "f"), ("х", "kh"),
    ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ъ", ""), ("ы", "y"), ("ь", ""),
    ("э", "e"), ("ю", "iu"), ("я", "ia"), ("ђ", "dj"), ("є", "ie"), ("ѕ", "dz"), ("і", "i"),
    ("ј", "j"), ("љ", "lj"), ("њ", "nj"), ("ћ", "tsh"), ("џ", "dzh"), ("ґ", "g"), ("ѣ", "ie"),
    ("ѳ", "f"), ("ѵ", "y"),
)
# --- end of fixed values --------------------------------------------------------------


def _spellings() -> tuple[str, str, list[tuple[str, str]]]:
    """Lower-case letters and their Latin spelling: one for one, and longer ones by themselves.

    Letters with marks go by their base letter, as Unicode decomposes them.
    """
    known = dict(_LIGATURES + _GREEK + _CYRILLIC)
    blocks = (range(0xC0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000))
    for code in (c for block in blocks for c in block):
        letter = chr(code)
        base = unicodedata.normalize("NFKD", letter)[0]
        plain = base.lower() if base.isascii() and base.isalpha() else known.get(base.lower())
        if plain is not None and letter not in known:
            known[letter] = plain
    known |= {chr(mark): "" for mark in range(0x300, 0x370)}
    # letters without a spelling come last: translate() removes what has no counterpart
    single = sorted((k for k in known if len(known[k]) < 2), key=lambda k: -len(known[k]))
    return "".join(single), "".join(known[k] for k in single), [
        (k, v) for k, v in known.items() if len(v) > 1]


_MARKED, _PLAIN, _LONGER = _spellings()


def to_latin(text: Column) -> Column:
    """Lower-cased text with Latin, Greek and Cyrillic letters spelled in a-z.

    Letters and digits of other scripts become the number of their code point, so texts that
    differ stay different.
    """
    text = F.lower(text)
    spelled = F.translate(text, _MARKED, _PLAIN)
    for letter, plain in _LONGER:
        spelled = F.replace(spelled, F.lit(letter), F.lit(plain))

    def numbered(char: Column) -> Column:
        other = char.rlike(r"[\p{L}\p{N}]") & (F.ascii(char) > 127)
        return F.when(other, F.concat(F.lit("u"), F.lower(F.hex(F.ascii(char))))).otherwise(char)

    def rest(text: Column) -> Column:
        chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
        return F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(chars, numbered), "")
                      ).otherwise(text)

    return F.when(text.rlike(r"[^\x00-\x7f]"), let(spelled, rest)).otherwise(text)


def slug(title: Column) -> Column:
    """Url-safe form of a title; thousands separators vanish, the rest becomes '-'."""
    text = F.regexp_replace(to_latin(title), r"(?<=\d),(?=\d)", "")
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))


def render_prompt(template: str, chars: int, title: Column, source: Column,
                  content: Column) -> Column:
    """Fill ``{title}``, ``{source}`` and ``{content}`` in a caller's template.

    The template is cut at its placeholders once, so text inside a value that looks
    like a placeholder is left alone.
    """
    values = {"title": title, "source": source, "content": preview(clean_text(content), chars)}
    pieces: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{%s}" % name), name) for name in values]
        found = [(at, name) for at, name in found if at >= 0]
        if not found:
            pieces.append(F.lit(rest))
            break
        at, name = min(found)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(values[name], F.lit("")))
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces) if pieces else F.lit("")
