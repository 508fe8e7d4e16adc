"""Text functions as native column expressions.  Regular expressions use (?U) where words or spaces are Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that may follow a suspended hyphen and are never glued on.
HYPHEN_STOPS = "and or to the a an in of on at by for with but nor not so yet".split()

#: Beginnings of sentences that a reader recites from its instructions.
ECHO_MARKERS = (
    "You are transcribing a photographed page",
    "Transcribe ONLY the flat",
    "Return ONLY a JSON object",
    '"markdown": transcribe the body text',
    "OMIT running headers",
    "in the page's own script and language",
    "若原書是繁體中文",
    "REFLOW the text into flowing paragraphs",
)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_line(c: Column) -> Column:
    """A line as headers are compared: no heading marks, punctuation or capitals, single spaces."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"^#{1,6}(?U:\s*)", ""), r"(?U)[^\w\s]", ""))
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def heal_hyphenation(c: Column) -> Column:
    """Joins words that a line's end split; suspended hyphens before HYPHEN_STOPS stay."""
    lines = F.regexp_replace(c, r"(?U)(\w)-\s*\n\s*([a-z])", "$1$2")
    return F.regexp_replace(lines, r"(?U)\b([A-Za-z]{2,})- (?!(?:" + "|".join(HYPHEN_STOPS) + r")\b)([a-z]{2,})\b", "$1$2")


def strip_echo(c: Column) -> Column:
    """Cut at the earliest recited instruction, with a trailing 'Rules:' before it."""
    at = F.least(*(F.when(F.contains(c, F.lit(m)), F.locate(m, c)) for m in ECHO_MARKERS))
    cut = F.regexp_replace(F.substring(c, F.lit(1), at - 1), r"(?U)\s+$", "")
    return F.when(at.isNull(), c).otherwise(F.regexp_replace(F.regexp_replace(cut, "Rules:$", ""), r"(?U)\s+$", ""))


def slug(c: Column) -> Column:
    """A readable file name: word characters in runs joined by hyphens, 60 at most, 'book' if none."""
    words = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s-]", "")
    name = F.substring(F.regexp_replace(F.regexp_replace(words, r"(?U)[\s_-]+", "-"), "^-+|-+$", ""), 1, 60)
    return F.when(name == "", "book").otherwise(name)


def markdown_slug(c: Column) -> Column:
    return F.regexp_replace(strip(F.regexp_replace(c, r"(?U)[^\w\s.-]", "")), r"(?U)\s+", "_")


def meta_escape(c: Column) -> Column:
    """Backslash before = ; # backslash and line feed."""
    return F.regexp_replace(c, r"([=;#\\\n])", r"\\$1")


def chapter_hash(c: Column) -> Column:
    return F.substring(F.sha1(strip(c).cast("binary")), 1, 16)


def narration(c: Column) -> Column:
    """Markdown as prose to read aloud: no notices, images, notes, tables, rules or markup; dashes audible."""
    t = F.regexp_replace(c, r"(?ms)^>\s*⟦.*?⟧\s*$", "")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"(?s)<sup>.*?</sup>|<sub>.*?</sub>", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"</?[a-zA-Z][^>]*>", "")
    lines = F.transform(F.split(t, "\n"), strip)
    lines = F.filter(lines, lambda s: ~s.startswith("|") & ~s.rlike(r"^[-*_]{3,}$"))
    t = F.array_join(F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, r"^#{1,6}\s+", ""), r"^[> ]+", "")), "\n")
    t = F.regexp_replace(t, r"(\*\*|__|\*|_|`)(.+?)\1", "$2")
    t = F.regexp_replace(F.replace(F.replace(t, F.lit("—"), F.lit(", ")), F.lit("–"), F.lit(" to ")), r"\[\[region-\d+\]\]", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def isbn10_valid(c: Column) -> Column:
    """Whether ten characters, digits but for a final X, sum to a multiple of 11 with weights 10 to 1."""
    u = F.upper(c)
    digit = lambda i: F.when(F.substring(u, i, 1) == "X", 10).otherwise(F.substring(u, i, 1).try_cast("int"))
    total = sum((digit(i) * (11 - i) for i in range(1, 11)), F.lit(0))
    return F.coalesce(u.rlike("^[0-9]{9}[0-9X]$") & (total % 11 == 0), F.lit(False))


def isbn13_sums(c: Column) -> Column:
    """Whether thirteen digits of any prefix sum to a multiple of 10 with weights 1 and 3 in turn."""
    total = sum((F.substring(c, i, 1).try_cast("int") * (1 if i % 2 else 3) for i in range(1, 14)), F.lit(0))
    return F.coalesce(c.rlike("^[0-9]{13}$") & (total % 10 == 0), F.lit(False))


def isbn13_valid(c: Column) -> Column:
    """The same of a book's number, which begins with 978 or 979."""
    return F.coalesce(c.rlike("^97[89]"), F.lit(False)) & isbn13_sums(c)


def block_kind(c: Column) -> Column:
    """What a Markdown block is set as: image, h1, h2, quote, list or para."""
    s = strip(c)
    return (
        F.when(s.rlike(r"^!\["), "image").when(s.rlike(r"^# "), "h1").when(s.rlike(r"^#{2,6} "), "h2")
        .when(s.startswith(">"), "quote").when(s.rlike(r"^([-*+]|[0-9]+[.)]) "), "list").otherwise("para")
    )


def figure_reference(text: Column, index: Column, link: Column) -> Column:
    """Puts a figure's link in place of its placeholder, or at the end unless it is there."""
    mark = F.concat(F.lit("[[region-"), index.cast("string"), F.lit("]]"))
    return F.when(F.contains(text, mark), F.replace(text, mark, link)).when(F.contains(text, link), text).otherwise(F.concat(text, F.lit("\n\n"), link))


def unresolved_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\[region-\d+\]\]\n?", "")


_UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def roman(n: int) -> str:
    out = ""
    for value, digits in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += digits * (n // value)
        n %= value
    return out


def number_title(n: Column, style: Column) -> Column:
    """Chapter n up to 20 as 'caps' (THREE), 'title' (Three) or 'roman' (III); 'Chapter n' otherwise."""
    pick = lambda words: F.try_element_at(F.array(*map(F.lit, words)), n)
    name = (
        F.when(style == "caps", pick([u.upper() for u in _UNITS])).when(style == "title", pick([u.title() for u in _UNITS]))
        .when(style == "roman", pick([roman(k) for k in range(1, 21)]))
    )
    return F.coalesce(F.when(n.between(1, 20), name), F.concat(F.lit("Chapter "), n.cast("string")))


def title_style(c: Column) -> Column:
    """How a heading names its number: caps, title or roman; null if it doesn't."""
    s = strip(F.regexp_replace(c, r"^#{1,6}\s+", ""))
    inside = lambda words: s.isin(*words)
    return F.when(inside([roman(k) for k in range(1, 21)]), "roman").when(inside([u.upper() for u in _UNITS]), "caps").when(inside([u.title() for u in _UNITS]), "title")


def heavy(base: Column, new: Column) -> Column:
    """Whether an edit changed a text's length by over 200 characters and over 5 %."""
    return F.abs(F.length(new) - F.length(base)) > F.greatest(F.lit(200.0), F.length(base) * 0.05)


def device_fit(width: Column, height: Column, most_width: int, most_height: int) -> Column:
    """Factor of at most 1 by which an image fits a screen."""
    return F.least(F.lit(1.0), most_width / width, most_height / height)


def upside_down(reply: Column) -> Column:
    """The truth value of an orientation reply, null if it has none."""
    body = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    v = F.try_variant_get(F.try_parse_json(body), "$.upside_down", "variant")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def figure_caption(text: Column, alt: Column, after: int = 400) -> Column:
    """A figure's alt text as caption, null where the text after the figure already says it."""
    return F.when((alt != "") & ~F.contains(F.lower(F.substring(text, 1, after)), F.lower(alt)), alt)


def toc_link(title: Column, number: Column, known: Column) -> Column:
    """A contents line as list item, linked where the chapter is known."""
    shown = F.concat_ws(" ", title, number.cast("string"))
    return F.concat(F.lit("- "), F.when(known.isNotNull(), F.concat(F.lit("["), shown, F.lit("]("), known, F.lit(")"))).otherwise(shown))


def join_halves(parts: Column) -> Column:
    """Readings of the parts of one page as one text.

    A word hyphenated at the cut is joined, a sentence that goes on follows after a space, and a
    heading, list or quote, or what follows the end of a sentence, is a paragraph of its own.
    """
    block = r"^((#{1,6}|[-*+]|\d+[.)])[^\S\n]|>)"
    end = lambda c: F.substring(c, -1, 1)

    def step(out: Column, part: Column) -> Column:
        before = F.regexp_replace(out, r"(?U)\s+$", "")
        ended = end(before).isin(*".!?:;\"')]}")
        return (
            F.when(out == "", part)
            .when(end(before) == "-", F.concat(F.regexp_replace(before, "-$", ""), part))
            .when((before != "") & ~ended & ~part.rlike(block), F.concat(before, F.lit(" "), part))
            .otherwise(F.concat(before, F.lit("\n\n"), part))
        )

    filled = F.filter(F.transform(parts, lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: p != "")
    return F.aggregate(filled, F.lit(""), step)


def voice_description(character: Column, sounds_like: Column) -> Column:
    """A prompt for a voice from what is known of a character; names of others say nothing and go."""

    def qualities(c: Column) -> Column:
        bare = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\.+$", "")
        bare = F.regexp_replace(bare, r"(?U)\s*[—-]?\s*(similar to|in the vein of|like)\s+[A-Z][^,;.]*", "")
        return F.regexp_replace(bare, "^[ ,;—-]+|[ ,;—-]+$", "")

    known = F.array_join(F.filter(F.array(qualities(character), qualities(sounds_like)), lambda x: x != ""), "; ")
    voice = F.when(known == "", "a neutral, pleasant adult voice").otherwise(known)
    return F.concat(
        F.lit("A speaker with this character: "), voice,
        F.lit(". Moderate pace, expressive but controlled delivery, very clear audio, close-up recording with no background noise."),
    )


def labelled_isbns(c: Column) -> Column:
    """The valid book numbers that a text labels as such, digits alone, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)ISBN[\s:–-]*([\dXx][\dXx\s–-]{7,17}[\dXx])"), F.lit(1))
    digits = F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"[^\dXx]", "")))
    return F.filter(digits, lambda d: isbn13_valid(d) | isbn10_valid(d))
