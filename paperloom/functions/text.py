"""Text scalars as column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, patterns and labels that results depend on.
ENCLITICS = ("se", "lo", "la", "los", "las", "no", "na", "nos", "nas", "lhe", "lhes")
COMMON_HEADINGS = (
    "abstract", "resumo", "introduction", "introdução", "conclusion", "conclusão", "conclusions", "conclusões", "references",
    "referências", "bibliography", "bibliografia", "acknowledgments", "acknowledgements", "agradecimentos", "appendix", "apêndice",
    "anexo", "annex", "background", "methods", "methodology", "metodologia", "results", "resultados", "discussion", "discussão",
    "summary", "overview",
)
LEGAL_TERMS = (
    "capítulo", "artigo", "seção", "parágrafo", "inciso", "alínea", "lei", "decreto", "constituição", "emenda", "resolução",
    "contrato", "cláusula", "título", "livro", "parte", "subseção", "anexo", "considerando", "diante do exposto", "tese", "mérito",
    "pedido", "defesa", "recurso", "sentença", "acórdão", "decisão", "voto", "relatório",
)
BOILERPLATE = r"^Continue from your last visit|^(FULLSCREEN|COPY LINK|CONTINUE READING|LINK)$|^[0-9]+\s*/\s*[0-9]+$|^(?i:page)\s+[0-9]+\s+(?i:of)\s+[0-9]+$"
#: Accented letters stand in both cases, since the engines fold only ASCII under (?i:).
PAGE_LABEL = r"^\s*(?i:p[aáÁ]gina|p[aáÁ]g\.?|fl\.?|folha|page|p\.)\s*[0-9]+"
SUPERS, SUBS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉"
ANAPHORA = (
    "este", "esta", "estes", "estas", "esse", "essa", "esses", "essas", "aquele", "aquela", "aqueles", "aquelas", "seu", "sua", "seus", "suas",
    "lhe", "lhes", "o", "a", "os", "as", "mesmo", "mesma", "mesmos", "mesmas", "tal", "tais", "cujo", "cuja", "cujos", "cujas",
)
PARTIES = (
    "apelante", "apelado", "recorrente", "recorrido", "reclamante", "reclamado", "autor", "réu", "requirente", "requerido", "embargante",
    "embargado", "exequente", "executado", "impetrante", "impetrado", "agravante", "agravado",
)
LOOKING_BACK = (
    "diante do exposto", "ante o exposto", "isto posto", "nesse sentido", "dessa forma", "desse modo", "assim sendo", "portanto", "contudo",
    "todavia", "no entanto", "entretanto", "por fim", "ademais",
)
#: Openings of headings in legal texts, for the features of a unit, and headings that a page adds and no author wrote.
LEGAL_OPENINGS = ("capítulo", "título", "art.", "seção", "subseção", "livro", "parte")
BOILERPLATE_HEADINGS = ("fullscreen", "copy link", "continue reading", "link", "continue from your last visit")
LETTER = "a-zA-ZáàâãéèêíïóôõöúçñÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ"


def strip(c: Column) -> Column:
    r"""Without white space (\s of regular expressions) at either end; Spark's trim takes spaces only."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def is_boilerplate(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(BOILERPLATE), F.lit(False))


def drop_boilerplate(c: Column) -> Column:
    """The text without its boilerplate lines."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_boilerplate(x)), "\n")


def drop_page_markers(c: Column) -> Column:
    """Without ``n/m`` tokens inside lines."""
    return strip(F.regexp_replace(c, r"\b[0-9]+\s*/\s*[0-9]+\b", ""))


def list_kind(c: Column) -> Column:
    """bullet, ordered or null by the text's first mark."""
    return F.when(c.rlike(r"^[-•–*]\s"), "bullet").when(c.rlike(r"^([0-9]+|[a-z])[.)]\s"), "ordered")


def repair_hyphens(c: Column) -> Column:
    """Words that a hyphen breaks across lines joined; before an enclitic pronoun the hyphen stays."""
    enclitic = "|".join(sorted(ENCLITICS, key=len, reverse=True))
    kept = F.regexp_replace(c, rf"([{LETTER}]{{2,}})-\n\s*((?i:{enclitic}))(?![{LETTER}])", "$1-$2")
    return F.regexp_replace(kept, rf"([{LETTER}]{{2,}})-\n\s*([{LETTER}]{{2,}})", "$1$2")


def script_digits(c: Column) -> Column:
    """Super- and subscript digits as ``^d`` and ``_d``, one by one."""
    digits = "0123456789"
    up = F.regexp_replace(c, f"([{SUPERS}])", "^$1")
    down = F.regexp_replace(up, f"([{SUBS}])", "_$1")
    return F.translate(down, SUPERS + SUBS, digits + digits)


def caret_notation(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\^\{([^}]+)\}", "_{$1}"), r"([a-zA-Z)\]])\^([0-9]+)", "$1^{$2}")


def digit_subscripts(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-zA-Z)])([0-9]{2,})(?=[a-zA-Z\s,;.]|$)", "$1_{$2}")


def has_math(c: Column) -> Column:
    return c.rlike(f"[\\^_{SUPERS}{SUBS}{{}}]") | c.rlike(r"[a-zA-Z)][0-9]{2,}([a-zA-Z\s,;.]|$)")


def rebuild_math(c: Column) -> Column:
    return F.when(has_math(c), digit_subscripts(caret_notation(script_digits(c)))).otherwise(c)


def token_count(c: Column) -> Column:
    """Estimated tokens: a third of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 3).cast("int"))


def tail(c: Column, target: int) -> Column:
    """The last part of a text that holds about ``target`` tokens, left-trimmed."""
    cut = F.floor(F.length(c) * target / token_count(c)).cast("int")
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(token_count(c) <= target, c).otherwise(F.regexp_replace(F.substr(c, F.length(c) - cut + 1), r"^\s+", ""))


def escape_html(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


UP = "A-ZÀ-Ú"
NUMBERING = {
    "keyword": r"^\s*(?i:EXERC[ÍIíi]CIO|EXERCISE|PROBLEM|QUEST[AÃaã]O|SECTION|CHAPTER)\s+[0-9]+",
    "appendix": r"^\s*(?i:APPENDIX|APP[.]|ANEXO)\s+[A-Za-z0-9]+",
    "dotted": r"^\s*[0-9]+\.[0-9]+(\.[0-9]+)*(\s+[—–‑-]\s*|\s+)[A-Za-zÀ-Úà-ú]",
    "lone": r"^\s*[0-9]+(\s+[—–‑-]\s*|\s+)[A-Za-zÀ-Úà-ú]",
    "data": r"^\s*[0-9]+(\s+[—–‑-]\s*|\s+)[A-Za-zÀ-Úà-ú][^\n]*[0-9]{2,}\s",
    "roman": r"^\s*[IVXLCDMivxlcdm]+\.\s+",
    "letter": r"^\s*[A-Za-z]\.\s+",
    "deep": r"^\s*[0-9]+\.[0-9]+\.[0-9]+",
}


def heading_level(c: Column) -> Column:
    """The level that a heading's numbering shows, or null. Lower-case numerals and letters count by their dot.

    Most texts show none, so one pattern of all that open a numbering stands before the single ones.
    """
    r = {k: c.rlike(v) for k, v in NUMBERING.items()}
    opens = "|".join(NUMBERING[k].removeprefix(r"^\s*") for k in ("dotted", "lone", "roman", "letter", "keyword", "appendix"))
    return F.when(
        c.rlike(rf"^\s*({opens})"),
        F.when(r["dotted"], F.when(r["deep"], 3).otherwise(2)).when(r["lone"] & ~r["data"], 1)
        .when(c.rlike(r"^\s*[IVXLCDM]+\.\s"), 1).when(c.rlike(r"^\s*[A-Z]\.\s"), 2)
        .when(r["roman"] | r["letter"], 2).when(r["keyword"], 1).when(r["appendix"], F.when(c.rlike(r"^\s*(?i:APP[.])"), 2).otherwise(1)),
    )


def is_common_heading(c: Column) -> Column:
    return F.lower(collapse(c)).isin(*COMMON_HEADINGS)


def is_short_caps(c: Column) -> Column:
    return c.rlike(rf"^\s*[{UP}][{UP}\s]{{2,30}}$")


def is_page_label(c: Column) -> Column:
    return c.rlike(r"^\s*[0-9]+\s*$") | c.rlike(PAGE_LABEL)


def is_chapter_like(c: Column) -> Column:
    return c.rlike(r"^\s*(?i:cap[iíÍ]tulo|se[cçÇ][aãÃ]o|parte|t[iíÍ]tulo|livro)\s+[0-9]+")


def mostly_formatting(c: Column) -> Column:
    """True if over 60 % of the lines are marks, table rows or shorter than five characters."""
    rows = F.split(strip(c), "\n")
    odd = F.filter(rows, lambda x: x.rlike(r"^\s*[■•*-]\s*$|^\s*#{1,6}\s*$|^\s*\|.*\|\s*$") | (F.length(strip(x)) < 5))
    return F.size(odd) > F.size(rows) * 0.6


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def legal_ratio(c: Column) -> Column:
    """The share of words in the legal vocabulary."""
    w = words_of(c)
    return F.size(F.filter(w, lambda x: x.isin(*LEGAL_TERMS))) / F.greatest(F.size(w), F.lit(1))


def matches(c: Column, words: tuple[str, ...]) -> Column:
    """The words of ``c`` (runs of letters, lower-cased) that are in ``words``."""
    return F.filter(F.split(F.lower(c), "[^a-zà-öø-ÿ0-9_]+"), lambda w: w.isin(*words))


def has_word(c: Column, words: tuple[str, ...]) -> Column:
    """Whether any of `matches` is there: the search ends at the first."""
    letter = "[a-zà-öø-ÿ0-9_]"
    return F.lower(c).rlike(rf"(?<!{letter})({'|'.join(words)})(?!{letter})")


def starts_looking_back(c: Column) -> Column:
    first = F.lower(F.substring_index(c, "\n", 1))
    return F.coalesce(first.rlike(r"^\s*(" + "|".join(LOOKING_BACK) + r")([^a-zà-öø-ÿ0-9_]|$)"), F.lit(False))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?]\s+"), strip), lambda s: s != "")


def coref_density(c: Column) -> Column:
    """Anaphora and party words per sentence, 4 places; 0 with fewer than two sentences."""
    s = sentences(c)
    total = F.aggregate(s, F.lit(0), lambda a, x: a + F.size(matches(x, ANAPHORA)) + F.size(matches(x, PARTIES)))
    return F.when(F.size(s) < 2, F.lit(0.0)).otherwise(F.bround(total / F.size(s), 4))


def tree_depth(c: Column) -> Column:
    """Deepest nesting of parentheses."""
    step = lambda a, x: F.struct((a["d"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)).alias("d"), F.greatest(a["m"], a["d"] + F.when(x == "(", 1).otherwise(0)).alias("m"))
    return F.aggregate(F.split(c, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda a: a["m"])


def heading_guess(c: Column) -> Column:
    """The first non-blank line as a heading, if it is marked as one or is short and has no final dot."""
    first = F.try_element_at(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), F.lit(1))
    marked = F.regexp_extract(first, r"^#{1,6}\s+(.+)$", 1)
    return F.when(marked != "", strip(marked)).when((F.length(first) < 120) & ~first.endswith("."), first)


def json_from_text(c: Column, schema: str) -> Column:
    """The first ``{...}`` of a free text, fences taken off, parsed; null where there is none."""
    body = F.regexp_extract(F.regexp_replace(c, r"```(json)?", ""), r"(?s)\{.*\}", 0)
    return F.from_json(F.nullif(body, F.lit("")), schema)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity: the product over the shorter length, norms over the full ones, 0 if a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot / F.nullif(both, F.lit(0.0)))


def cache_key(content: Column, params: Column) -> Column:
    """SHA-256 over a content and all of its parameters."""
    return F.sha2(F.concat(content, params), 256)
