"""Text functions: normalisation, predicates on lines, masking helpers, joins of broken lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs that some fonts use for others.
LIGATURES = {"˚": "fi", "˜": "fl", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
SEPARATORS = {"Œ": "-", "™": "'", "‚": "'"}
DROPPED = ("ﬁ", "ﬂ", "ﬀ", "ﬃ", "ﬄ", "˚", "˜")

# The patterns of line predicates.
HEADING = r"^\d+(\.\d+)*\.?\s+[A-Z]"
HEADING_UNIT = r"^\d+(?:\.\d+)*\.?\s+(?:MHz|GHz|kHz|Hz|NM|nm|ft|feet|km|kg|lbs?|kt|kts|mm|cm|m|s|sec|min|hrs?|hours?|%|°[CF]?|dB|psi|mi|yd)\b"
CAPTION = r"(?i)^(Fig\.?|Figure|Table)\b"
CONTACT = (r"\(\d{3}\)\s?\d{3}[-–]\d{4}", r"\+\d[\d\s().\-]{7,}\d$", r"(?i)\bP\.?\s?O\.?\s?Box\s+\d+", r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b")
REFERENCE = r"^(?:\d+\.\s+|\[\d+\]\s*)[A-Z](?:[A-Za-z]+|\.)"
BIBLIOGRAPHY = r"^\[?\d{1,3}[.\]]\s+(?:[A-Z][A-Za-z'’-]+,\s*[A-Z]\.|[A-Z]\.\s*[A-Z][A-Za-z'’-]+,)"
NUMBER_TOKEN = r"^[\d.,%×x±+\-/()]+$"
NUMBER_CELL = r"^[$€£¥]?[\d.,%×x±+\-/()<>≈=]+$"
UNIT_TOKEN = r"(?i)^(?:m|cm|mm|km|kg|g|lb|lbs|ft|in|kt|kts|kph|mph|nm|shp|hp|kw|kn|s|sec|min|hr|hrs|hours?|x|×|/|%|°[cf]?|ft/min|m/s\d?|kg/m\d?)$"
REAL_WORD = r"\b(?:[A-Za-z][a-z]{2,}|[A-Z]{3,})\b|[a-z]{3,}"
LIST_MARK = r"^\s*[•‣⁃▪●–—・·∙]\s*|^\s*[-–—]\s+"
FOOTER = r"(?i)(doi:|©|rights reserved|front matter|\d{4}-\d{3,4}|Corresponding author|E-mail address|Received \d|received in revised|accepted \d)"
WEB_END = r"(?:https?://\S+|www\.\S+|\S+@\S+\.\w+|\.(?:com|gov|org|net|edu|io|mil)(?:/\S*)?)$"
PLACEHOLDER = r"⟦T\d+⟧"
MATH_CHARS = r"[Ͱ-Ͽ←-⇿∀-⋿⁰-₟⟀-⟯⨀-⫿±×÷∞ƒ]"


def _replace_all(c: Column, pairs: dict[str, str]) -> Column:
    for k, v in pairs.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def match_key(c: Column) -> Column:
    """ligatures expanded, font artefacts mapped, ASCII letters and digits kept, lower case."""
    return F.lower(F.regexp_replace(_replace_all(c, LIGATURES | SEPARATORS), "[^0-9A-Za-z]", ""))


def match_key_drop(c: Column) -> Column:
    """as match_key, but doubtful ligature glyphs go."""
    return F.lower(F.regexp_replace(_replace_all(c, SEPARATORS | dict.fromkeys(DROPPED, "")), "[^0-9A-Za-z]", ""))


def wide_key(c: Column) -> Column:
    """letters and digits of any script, lower case."""
    return F.lower(F.regexp_replace(_replace_all(c, LIGATURES), r"[^\p{L}\p{N}]", ""))


def strip_digits(c: Column) -> Column:
    """F04."""
    return F.regexp_replace(c, "[0-9]", "")


def furniture_key(c: Column) -> Column:
    """the key of running furniture: no digits or white space, lower case, 40 characters."""
    return F.substring(F.lower(F.regexp_replace(c, r"[0-9\s]", "")), 1, 40)


def strip_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def is_heading(c: Column) -> Column:
    """Numbered heading, unless a measurement."""
    return c.rlike(HEADING) & ~c.rlike(HEADING_UNIT)


def is_caption(c: Column) -> Column:
    """P04."""
    return c.rlike(CAPTION)


def is_contact(c: Column) -> Column:
    """A line of at most 64 characters that is contact data and at most three more words."""
    t, hit = F.trim(c), F.lit(False)
    for p in CONTACT:
        rest = F.split(F.regexp_replace(t, f"^(.*?)(?:{p})(.*)$" if not p.startswith("(?i)") else f"(?i)^(.*?)(?:{p[4:]})(.*)$", "$1 $2"), r"\s+")
        hit = hit | (t.rlike(p) & (F.size(F.filter(rest, lambda w: w.rlike("[A-Za-z]"))) <= 3))
    return (F.length(t) > 0) & (F.length(t) <= 64) & hit


def is_reference(c: Column) -> Column:
    """P06."""
    return c.rlike(REFERENCE)


def is_bibliography(c: Column) -> Column:
    """P06, strict."""
    return c.rlike(BIBLIOGRAPHY)


def is_reference_heading(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("references", "bibliography", "literature cited")


def math_score(c: Column, font_share: Column | None = None) -> Column:
    """Share of mathematical characters, or of mathematical fonts if that is more."""
    density = F.regexp_count(c, F.lit(MATH_CHARS)) / F.greatest(F.length(c), F.lit(1))
    return density if font_share is None else F.greatest(density, font_share)


def is_mathish(c: Column, score: Column) -> Column:
    """A strong signal and at most two real words of four letters."""
    words = F.filter(F.regexp_extract_all(c, F.lit("([A-Za-z]{4,})"), 1), lambda w: ~F.lower(w).isin("sinh", "cosh", "tanh", "sqrt") & ~w.rlike(r"^(?:([A-Za-z])\1)+$"))
    return (score >= 0.28) & (F.size(words) <= 2)


def tokens(c: Column) -> Column:
    """Words by white space; dot leaders are none."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.regexp_replace(w, "[.·⋅⋯]", "") != "")


def is_number_row(c: Column) -> Column:
    """P10: two tokens or more, most of them numbers."""
    t = tokens(c)
    return (F.size(t) >= 2) & (F.size(F.filter(t, lambda w: w.rlike(NUMBER_TOKEN))) * 2 > F.size(t))


def is_numericish(c: Column) -> Column:
    """A digit, and most tokens numbers or units."""
    t = tokens(c)
    hits = F.size(F.filter(t, lambda w: w.rlike(NUMBER_CELL) | w.rlike(UNIT_TOKEN)))
    return c.rlike("[0-9]") & (F.size(t) > 0) & (hits * 2 > F.size(t))


def caps_ratio(c: Column) -> Column:
    """Share of capitals; null under six letters."""
    n = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(n >= 6, F.regexp_count(c, F.lit(r"\p{Lu}")) / n)


def has_real_word(c: Column) -> Column:
    """P12."""
    return F.coalesce(c.rlike(REAL_WORD), F.lit(False))


def is_footer(c: Column) -> Column:
    """P13."""
    return F.coalesce(c.rlike(FOOTER), F.lit(False))


def is_list_item(c: Column) -> Column:
    """P14."""
    return c.rlike(LIST_MARK)


def continues(prev: Column, nxt: Column, next_type: Column) -> Column:
    """Whether a block goes on from the one before. Null neighbours never do."""
    t, h = F.rtrim(prev), F.ltrim(nxt)
    closed = F.regexp_replace(t, r"[\s\d,–\-]+$", "").rlike(r"[.!?。:;]$")
    opens = h.rlike(r"^[\p{Ll}(‘’\"'\d]")
    return F.coalesce(
        F.when((t == "") | (h == "") | next_type.isin("heading", "title", "caption"), False)
        .when(is_footer(t) | is_footer(h), False)
        .when(t.endswith("-"), True)
        .when(t.rlike(WEB_END), False)
        .when(closed, False)
        .when(opens, True)
        .otherwise(F.length(t) >= 80),
        F.lit(False),
    )


def is_echo(c: Column, share: float = 0.45) -> Column:
    """Mostly ASCII letters."""
    return F.coalesce(F.length(F.regexp_replace(c, "[^A-Za-z]", "")) > share * F.greatest(F.length(c), F.lit(1)), F.lit(False)) & (F.length(c) > 0)


def placeholders(c: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(c, F.lit(f"({PLACEHOLDER})"), 1))


def placeholders_equal(a: Column, b: Column) -> Column:
    """P19."""
    return placeholders(a) == placeholders(b)


def digits_survive(values: Column, out: Column) -> Column:
    """P20: each value's digits, without trailing zeros, are among the runs of out, give or take four digits."""
    runs = F.transform(F.regexp_extract_all(out, F.lit(r"([0-9.,]+)"), 1), lambda r: F.regexp_replace(r, "[^0-9]", ""))

    def sig(d: Column) -> Column:
        s = F.regexp_replace(d, "0+$", "")
        return F.when((s == "") & (d != ""), F.lit("0")).otherwise(s)

    def survives(v: Column) -> Column:
        d = F.regexp_replace(v, "[^0-9]", "")
        return (d == "") | F.exists(runs, lambda r: (sig(r) == sig(d)) & (F.abs(F.length(r) - F.length(d)) <= 4))

    return F.forall(values, survives)


def is_token_only(c: Column) -> Column:
    """Nothing but placeholders and marks."""
    return ~F.regexp_replace(c, PLACEHOLDER, "").rlike("[A-Za-z]{2,}")


def has_japanese(c: Column) -> Column:
    """P35."""
    return c.rlike(r"[぀-ヿ一-鿿｡-ﾟ]")


def latin_words(c: Column, least: int = 4) -> Column:
    return F.regexp_extract_all(c, F.lit(f"([A-Za-z]{{{least},}})"), 1)


def is_unit_echo(target: Column, source: Column) -> Column:
    """P22."""
    return ~has_japanese(target) & (match_key(target) == match_key(source))


def is_badge(c: Column, size: Column, nlines: Column) -> Column:
    """P23."""
    return (nlines == 1) & (size <= 6.5) & F.trim(c).rlike(r"^(?=.*[A-Z])[^a-z]{1,8}$")


def is_leader(c: Column) -> Column:
    """Five leader dots or more."""
    return c.rlike(r"(?:[.·⋅⋯]\s*){5,}")


def is_fragment(c: Column) -> Column:
    """P27."""
    return F.length(match_key(c)) <= 3


def sentences(c: Column) -> Column:
    """F08."""
    return F.split(c, r"(?<=[.!?;:])\s+")


def fix_glyphs(c: Column) -> Column:
    """unmapped glyphs become a dash, private-use characters a bullet."""
    return F.regexp_replace(F.regexp_replace(c, r"\(cid:\d+\)", "-"), r"[\uE000-\uF8FF]", "•")


def drawable(c: Column, missing: str) -> Column:
    """each character of the class `missing` becomes a bullet; the length stays."""
    return F.regexp_replace(c, missing, "•")


def ascii_cjk(c: Column) -> Column:
    """F13."""
    return F.regexp_replace(c, r"[^\x20-\x7E　-ヿ㐀-鿿＀-￯]", "")


def pad_placeholders(c: Column) -> Column:
    """F09."""
    return F.regexp_replace(c, f"({PLACEHOLDER})", " $1 ")


def tighten_placeholders(c: Column) -> Column:
    """white space around a placeholder goes; digits that came back as numbers are joined."""
    joined = F.regexp_replace(c, r"(?<=⟦[TＴ ]{0,3}[\d,. ]{0,12})[,.\s](?=[\d,.\s]*⟧)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"⟦\s*[TＴ]\s*", "⟦T"), r"\s+(⟦T\d+⟧)", "$1"), r"(⟦T\d+⟧)\s+", "$1")


def restore(masked: Column, tokens_map: Column) -> Column:
    """placeholders back to their values."""
    return F.aggregate(F.map_entries(tokens_map), masked, lambda a, e: F.replace(a, e["key"], e["value"]))


def content_key(*parts: Column) -> Column:
    """the key of the translation cache."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def progress_event(c: Column) -> Column:
    """role, detail, done and total of a progress line."""
    return F.struct(
        F.nullif(F.regexp_extract(c, r"^\[([\w-]+)\]\s*(.*)$", 1), F.lit("")).alias("role"),
        F.nullif(F.regexp_extract(c, r"^\[([\w-]+)\]\s*(.*)$", 2), F.lit("")).alias("detail"),
        F.nullif(F.regexp_extract(c, r"translated (\d+)/(\d+) units", 1), F.lit("")).cast("int").alias("done"),
        F.nullif(F.regexp_extract(c, r"translated (\d+)/(\d+) units", 2), F.lit("")).cast("int").alias("total"),
    )


def safe_filename(c: Column) -> Column:
    """F22."""
    return F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"[^\w.\-]", "_")


def client_ip(forwarded: Column, peer: Column) -> Column:
    """the first forwarded address, else the peer's."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), peer)


def html_escape(c: Column) -> Column:
    """F24."""
    return _replace_all(c, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})


def join_lines(lines: Column) -> Column:
    """Line texts in order; a split URL joins without space, a split word loses its hyphen."""

    def add(text: Column, t: Column) -> Column:
        last = F.regexp_extract(text, r"(\S+)$", 1)
        return (
            F.when(text == "", t)
            .when(last.rlike(r"^(?:https?://|www\.)") & last.rlike(r"[/\-_=?&.]$"), F.concat(text, t))
            .when(last.rlike(r"^\p{L}{2,}-$") & t.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(text, "-$", ""), t))
            .otherwise(F.concat(text, F.lit(" "), t))
        )

    return F.trim(F.aggregate(lines, F.lit(""), add))


def join_unit(parts: Column) -> Column:
    """The texts of a unit's blocks; a trailing hyphen joins."""
    return F.aggregate(F.transform(parts, F.trim), F.lit(""), lambda a, t: F.when(a == "", t).when(a.endswith("-"), F.concat(F.regexp_replace(a, "-$", ""), t)).otherwise(F.concat(a, F.lit(" "), t)))


def english_date(c: Column) -> Column:
    """the first English date of a text, in Japanese order; null without one."""
    # Month names.
    names = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
    full = "January|February|March|April|May|June|July|August|September|October|November|December"
    number = F.create_map(*[x for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1) for x in (F.lit(m), F.lit(str(i)))])

    def form(pattern: str, month: int, day: int | None, year: int) -> Column:
        mon = F.element_at(number, F.lower(F.substring(F.regexp_extract(c, pattern, month), 1, 3)))
        parts = [F.regexp_extract(c, pattern, year), F.lit("年"), mon, F.lit("月")]
        if day is not None:
            parts += [F.regexp_extract(c, pattern, day).cast("int").cast("string"), F.lit("日")]
        return F.when(c.rlike(pattern), F.concat(*parts))

    return F.coalesce(
        form(rf"\b({names})\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})\b", 1, 2, 3),
        form(rf"\b([0-9]{{1,2}})\s+({names})\.?,?\s+([0-9]{{4}})\b", 2, 1, 3),
        form(rf"\b({full})\.?,?\s+([0-9]{{4}})\b", 1, None, 2),
    )
