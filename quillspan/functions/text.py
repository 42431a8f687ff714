"""Text scalars as native column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to a base letter, and Spanish words without retrieval signal.
FOLD_FROM = "áàâäãåéèêëíìîïóòôöõúùûüçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÝ"
FOLD_TO = "aaaaaaeeeeiiiiooooouuuucyyaaaaaaeeeeiiiiooooouuuucy"
STOPWORDS = """
con por para que los las una uno unos unas del sus esta este esto estos estas
ese esa eso esos esas aquel aquella aquello ser son era eran fue fueron sido
siendo han has hay haber habia habian hace hacer hecho puede pueden podia
podian debe deben tiene tienen tenia tenian tener como cuando donde porque
pero sino aunque mientras segun sobre entre hasta desde sin tras ante bajo
cada todo toda todos todas otro otra otros otras mismo misma mismos mismas
tan tanto tambien solo solamente muy mas menos algo alguno alguna algunos
algunas nada nadie ningun ninguna cual cuales quien quienes cuyo cuya asi
aqui alli ahora luego entonces despues antes siempre nunca aun ademas decir
dice dicen dicho les nos ello ella ellos ellas usted ustedes ver vez veces
modo manera caso pues bien cierto cierta
""".split()
MIN_TOKEN_LEN = 3
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
SCRIPTURE = r"\b(?:([123])\s*)?([a-zñ]{2,16})\.?\s*(\d{1,3}):(\d{1,3})"


def fold(text: Column) -> Column:
    """Lower case without accents; ñ stays a letter of its own."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def words(text: Column) -> Column:
    """Folded runs of letters and digits, of three characters or more, without stopwords."""
    found = F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(found, lambda w: (F.char_length(w) >= MIN_TOKEN_LEN) & ~w.isin(STOPWORDS))


def reference_tokens(text: Column) -> Column:
    """Compound tokens (``juan10v6``) for chapter-and-verse references in a text.

    Texts without a digit, colon and digit are not searched; in others each reference is
    found once and taken apart by itself.
    """
    low = fold(text)
    part = lambda m, i: F.regexp_extract(m, SCRIPTURE, i)
    found = F.when(low.rlike(r"\d:\d"), F.regexp_extract_all(low, F.lit(SCRIPTURE), 0)).otherwise(F.array().cast("array<string>"))
    kept = F.filter(found, lambda m: ~part(m, 2).isin(STOPWORDS))
    return F.transform(kept, lambda m: F.concat(part(m, 1), part(m, 2), part(m, 3), F.lit("v"), part(m, 4)))


def tokenize(text: Column) -> Column:
    """Index terms of a text: words and reference tokens, repeats included."""
    return F.concat(words(text), reference_tokens(text))


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    raw = F.encode(token, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("bigint")
    places = F.when(F.octet_length(token) > 0, F.sequence(F.lit(1), F.octet_length(token))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(FNV_OFFSET).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def digest(*parts: Column, digits: int = 24) -> Column:
    """Deterministic id over NUL-joined parts."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits)


def version_id(sha256: Column, tenant: Column, legacy: str = "default") -> Column:
    """Content id: the plain hash for the legacy tenant, salted by the tenant otherwise."""
    return F.when(tenant == legacy, F.substring(sha256, 1, 24)).otherwise(digest(tenant, sha256))


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_name(name: Column) -> Column:
    """Concept key: folded, punctuation to blanks, collapsed."""
    return collapse(F.regexp_replace(fold(name), r"[^\p{L}\p{N}]+", " "))


def clean_layout_text(text: Column) -> Column:
    """Text from page layout: private glyphs and soft hyphens out, hyphen breaks joined."""
    out = F.regexp_replace(text, "[-­�]", "")
    out = F.regexp_replace(out, r"(\p{L})-\n(\p{Ll})", "$1$2")
    return F.regexp_replace(out, "[ \t]{2,}", " ")


def normal_header(header: Column) -> Column:
    """Header pattern: digits to #, collapsed, upper case."""
    return F.upper(collapse(F.regexp_replace(header, r"\d+", "#")))


def slug(name: Column, fingerprint: Column) -> Column:
    """Lower-case dashed name of at most 48 characters with a short fingerprint."""
    base = F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", F.substring(base, 1, 48), F.substring(fingerprint, 1, 8))


def clock(seconds: Column) -> Column:
    """h:mm:ss of a number of seconds."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def locator(title: Column, page: Column, sheet: Column, slide: Column, section: Column, start: Column, end: Column) -> Column:
    """Human-readable place of a chunk; absent parts are skipped."""
    return F.concat_ws(
        " · ", title, F.concat(F.lit("p. "), page.cast("string")), F.concat(F.lit("hoja "), sheet), F.concat(F.lit("diapositiva "), slide.cast("string")),
        section, F.concat(F.lit("["), start.cast("string"), F.lit(":"), end.cast("string"), F.lit("]")),
    )


def suspect_encoding(text: Column) -> Column:
    """Percent-encoding that decodes to something else, or marks of a wrong decoding."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return (text.rlike("%[0-9A-Fa-f]{2}") & decoded.isNotNull() & (decoded != text)) | text.rlike("Ã[\u0080-¿]|â€|�")


def quote_still_locates(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text up to white space; null without a quote."""
    found = F.contains(collapse(text), collapse(quote))
    return F.when(quote.isNull() | (quote == ""), None).when(text.isNull() | (text == ""), False).otherwise(found)


def quote_span(quote: Column, text: Column) -> Column:
    """Byte span (begin, end) of the first verbatim occurrence of a quote; null if absent."""
    at = F.instr(text, quote)
    begin = F.octet_length(F.substring(text, F.lit(1), at - 1))
    return F.when(at > 0, F.struct(begin.alias("begin"), (begin + F.octet_length(quote)).alias("end")))


def price(rate_per_million: Column, tokens: Column) -> Column:
    """Cost of tokens; null where the model has no rate."""
    return tokens / F.lit(1e6) * rate_per_million


def numeric_text(value: Column) -> Column:
    """Whether a cell's text is a number once separators and percent signs are gone."""
    return F.regexp_replace(F.trim(value), "[,%]", "").try_cast("double").isNotNull()


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted array."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def closed(value: Column, allowed: list[str]) -> Column:
    """The value if it is one of a closed set, else null."""
    return F.when(value.isin(allowed), value)


def short_title(question: Column, limit: int = 80) -> Column:
    """Collapsed question, cut with an ellipsis beyond the limit."""
    c = collapse(question)
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


# Fixed value: the name space of deterministic point ids.
POINT_NAMESPACE = "6b686569726f5e738f63696f6c6f6779"


def point_id(document: Column, index: Column) -> Column:
    """Version-5 UUID over ``document:index`` in the fixed name space."""
    name = F.concat(document.cast("string"), F.lit(":"), index.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(name, "UTF-8")))
    # Version nibble 5, and the two variant bits 10 before what the hash has.
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8, 10, 16))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def path_id(path: Column) -> Column:
    """File name with a short hash of it."""
    name = F.substring_index(path, "/", -1)
    return F.concat(name, F.lit(":"), F.substring(F.sha2(name, 256), 1, 8))


# Fixed value: the form of chunk ids in prose.
CHUNK_ID = r"chk_[0-9a-f]{24}"


def clean_prose(text: Column) -> Column:
    """Prose without chunk ids, in brackets or bare, and with the punctuation behind them repaired."""
    out = F.regexp_replace(text, rf"\s*[\[(]\s*{CHUNK_ID}(?:\s*[,;]\s*{CHUNK_ID})*\s*[\])]", "")
    out = F.regexp_replace(out, rf"\s*\b{CHUNK_ID}\b", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"\s+([.,;:])", "$1"), r"[ \t]{2,}", " "), F.lit(" \t\r\n"))


def cursor(value: Column) -> Column:
    """(started_at, id) of a page cursor ``iso|id``; null where it can't be read."""
    at = F.split_part(value, F.lit("|"), F.lit(1)).try_cast("timestamp_ntz")
    return F.when(at.isNotNull(), F.struct(at.alias("started_at"), F.split_part(value, F.lit("|"), F.lit(2)).alias("id")))


def join_paragraphs(parts: Column) -> Column:
    """Trimmed paragraphs that are not blank, joined by blank lines."""
    return F.array_join(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != ""), "\n\n")


def repair_paragraph(text: Column) -> Column:
    """A paragraph whose inner blank lines are single line breaks, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"\n\s*\n", "\n"), r"^\s+|\s+$", "")


# Words that read as an exercise, and as a bibliographic aside.
IMPERATIVES = r"(?i)\b(defina|define|señale|senale|explique|mencione|indique|analice|compare|justifique|describa|enumere|argumente|comente|responda|complete)\b"
BIBLIOGRAPHIC = r"(?i)\b(ib[ií]d(em)?\b|[ií]dem\b|op\.\s*cit|loc\.\s*cit|pp?\.\s*\d)"
LONG_NOTE = 120


def reads_as_question(text: Column) -> Column:
    """Whether a text reads as a question or exercise, whatever its numbering."""
    return text.contains("¿") | F.endswith(F.regexp_replace(text, r"\s+$", ""), F.lit("?")) | text.rlike(IMPERATIVES)


def reads_as_note(text: Column) -> Column:
    """Whether a text reads as a bibliographic aside: cited or long, and no question."""
    return ~reads_as_question(text) & (text.rlike(BIBLIOGRAPHIC) | (F.char_length(text) > LONG_NOTE))


def semantic_counts(document: Column) -> Column:
    """(concepts, claims, quoted) of a JSON document of semantics; null where it is none."""
    parsed = F.from_json(document, "concepts array<string>, claims array<struct<quote:string>>")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    quoted = size(F.filter(parsed["claims"], lambda c: F.coalesce(c["quote"], F.lit("")) != ""))
    return F.when(document.rlike(r"^\s*\{"), F.struct(size(parsed["concepts"]).alias("concepts"), size(parsed["claims"]).alias("claims"), quoted.alias("quoted")))


def decomposed(text: Column) -> Column:
    """Exact compatibility decomposition without combining marks, for any script.

    Spark SQL has no normal forms, so this one scalar runs in Python, on Arrow batches; texts
    of ASCII alone are passed through. ``fold`` stays the native way for Latin letters.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            plain = value.as_py()
            if plain is not None and not plain.isascii():
                plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
            out.append(plain)
        return pa.array(out, pa.string())

    return run(text)


def exact_name(name: Column) -> Column:
    """Concept key in any script: case folded, decomposed, punctuation to blanks, collapsed."""
    return collapse(F.regexp_replace(F.lower(decomposed(F.lower(name))), r"[^\p{L}\p{N}]+", " "))
