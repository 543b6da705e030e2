"""Column functions on text. Those that Spark's own functions express stay in the JVM; the rest are Arrow batches."""

from __future__ import annotations

import html as html_escapes
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seamlode.functions.arrow import arrow

# Stems of words that ask rather than name a subject.
QUESTION_STEMS = [
    "метод", "способ", "существ", "техническ", "технолог", "решени", "применя", "значени", "диапазон", "вопрос", "привед", "перечисл", "вариант", "получ",
    "использ", "какие", "какой", "какая", "какое", "дают", "даёт", "дает", "между", "бывает", "бывают", "виды", "каков", "какими", "чему", "чего",
    "нужно", "можно", "также", "относят",
]
# Chemical elements that count as terms, in their own case.
ELEMENTS = [
    "Cu", "Ni", "Co", "Fe", "Zn", "Pb", "As", "Se", "Te", "Sb", "Bi", "Sn", "Ag", "Au", "Pt", "Pd", "Rh", "Ru", "Ir", "Cr", "Mn", "Mg", "Ca", "Al",
    "Si", "Ti", "Mo", "Cd", "Hg", "Ga", "Ge", "Re", "Tl", "Zr", "Nb", "Ta", "Na",
]
# Cyrillic letters that become several Latin ones, or none, and those that become one.
_MANY = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "щ": "shch", "ш": "sh", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}
_ONE = ("абвгдеёзийклмнопрстуфыэ", "abvgdeeziiklmnoprstufye")


def terms(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def found_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a regular expression, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def content_terms(text: Column, most: int = 14) -> Column:
    """Different words of four letters or digits and more that name a subject, in order; if none, all of five and more."""
    low = F.lower(text)
    words = F.filter(F.array_distinct(found_all(low, "[а-яёa-z0-9]{4,}")), lambda t: ~t.rlike("^(?:" + "|".join(QUESTION_STEMS) + ")"))
    return F.slice(F.when(F.size(words) > 0, words).otherwise(found_all(low, "[а-яёa-z0-9]{5,}")), 1, most)


def stemmed_in(text: Column, term: Column) -> Column:
    """Whether a text has a term, or a term of over five letters without its last two."""
    return F.contains(text, term) | ((F.length(term) > 5) & F.contains(text, F.left(term, F.length(term) - 2)))


def any_of(words: Column) -> Column:
    """Terms as a query of alternatives."""
    return F.array_join(words, " | ")


def is_element(token: Column) -> Column:
    return token.isin(*ELEMENTS)


def elements_in(text: Column) -> Column:
    """Element symbols of a text, in order."""
    tokens = found_all(text, r"[A-Za-zА-Яа-яёЁ0-9][A-Za-zА-Яа-яёЁ0-9\-.]*")
    return F.array_distinct(F.filter(tokens, is_element))


def boosted_terms(words: Column) -> Column:
    """Terms as array<struct(term, boost)>: other signs removed, short ones left out unless elements, boost 2 from seven signs on."""
    clean = F.transform(words, lambda w: F.trim(F.regexp_replace(w, r"[^0-9A-Za-zА-Яа-яёЁ\- ]", " ")))
    long = F.filter(clean, lambda w: (F.length(w) >= 4) | is_element(w))
    low = F.transform(long, F.lower)
    first = F.filter(long, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    return F.transform(first, lambda w: F.struct(w.alias("term"), F.when(F.length(w) >= 7, 2).otherwise(1).alias("boost")))


def boosted_query(words: Column) -> Column:
    """The same as a query text: phrases quoted, boosts by ^2, joined by OR."""
    quoted = lambda t: F.when(F.contains(t["term"], F.lit(" ")), F.concat(F.lit('"'), t["term"], F.lit('"'))).otherwise(t["term"])
    return F.array_join(F.transform(boosted_terms(words), lambda t: F.concat(quoted(t), F.when(t["boost"] == 2, "^2").otherwise(""))), " OR ")


def safe_lexemes(form: Column) -> Column:
    """One clean word of three signs or more as it is; anything else as its words of four and more."""
    t = F.lower(F.trim(form))
    single = t.rlike("^[а-яёa-z0-9]+$")
    return F.when(single, F.when(F.length(t) >= 3, F.array(t)).otherwise(F.array().cast("array<string>"))).otherwise(F.array_distinct(found_all(t, "[а-яёa-z0-9]{4,}")))


def looks_like_formula(term: Column) -> Column:
    """A digit after letters or beside a Latin letter: grades and formulas, which are not expanded."""
    return F.lower(term).rlike(r"^[a-zа-яё]*\d|[a-z]\d|\d[a-z]")


def is_formula_token(name: Column) -> Column:
    """A formula or symbol whose case counts: a digit, two capitals, or a capitalised name of two signs at most."""
    s = F.trim(name)
    capitals = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    return s.rlike(r"^[0-9A-Za-z()·.+\-]+$") & (s.rlike(r"\d") | (capitals >= 2) | ((F.length(s) <= 2) & s.rlike(r"^\p{Lu}")))


def bigrams(words: Column, most: int = 8) -> Column:
    """Adjacent words joined by a space."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(F.filter(pairs, lambda x: x.isNotNull()), 1, most)


def char_share(text: Column, chars: str) -> Column:
    """Share of the characters that a regex class matches; null for empty text."""
    return F.length(F.regexp_replace(text, f"[^{chars}]", "")) / F.nullif(F.length(text), F.lit(0))


def language(text: Column, least: float = 0.4, chars: int | None = 4000, strict: bool = True) -> Column:
    """ru if the share of Cyrillic among letters is over ``least`` (or at least that), else en; of the first ``chars`` characters, or all."""
    part = text if chars is None else F.left(text, F.lit(chars))
    letters = F.length(F.regexp_replace(part, r"[^\p{L}]", ""))
    cyrillic = F.length(F.regexp_replace(part, "[^а-яёА-ЯЁ]", ""))
    found = F.coalesce(cyrillic / F.nullif(letters, F.lit(0)), F.lit(0.0))
    return F.when(found > least if strict else found >= least, "ru").otherwise("en")


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of at most ``size`` characters, each sharing ``overlap`` with the one before."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - F.lit(overlap)) / F.lit(step)).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * step + 1, F.lit(size)))


def clean_lines(lines: Column) -> Column:
    """Lines without one that, blanks at its ends aside, equals the line before it; blank lines stay."""
    again = lambda x, i: (i > 0) & (F.trim(x) != "") & (F.trim(x) == F.trim(F.element_at(lines, F.greatest(i, F.lit(1)))))
    return F.filter(lines, lambda x, i: ~again(x, i))


def excerpt(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def clip(text: Column, size: int = 60) -> Column:
    """The text on one line, cut to ``size`` with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.trim(text), r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(size - 1))), F.lit("…")))


def provenance(value: Column, unit: Column, snippet: Column, locator: Column, size: int = 200) -> Column:
    """struct(value, unit, snippet, locator) as a citation shows it."""
    return F.struct(value.alias("value"), F.coalesce(unit, F.lit("")).alias("unit"), F.coalesce(excerpt(snippet, size), F.lit("")).alias("snippet"), locator.alias("locator"))


# -- names and paths --------------------------------------------------------------------

_EXTENSION = r"(?iu)\.(md|pdf|docx?|pptx?|txt)$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def clean_name(name: Column) -> Column:
    """Name of a document without its path and one extension; a fixed phrase for none."""
    base = base_name(name)
    bare = F.trim(F.regexp_replace(base, _EXTENSION, ""))
    return F.when(F.coalesce(name, F.lit("")) == "", "источник не указан").otherwise(F.when(bare == "", base).otherwise(bare))


def name_key(name: Column) -> Column:
    """Key by which names of one document agree: no path, none of its extensions, lower case."""
    base = F.trim(base_name(name))
    bare = F.trim(F.regexp_replace(base, r"(?iu)(\s*\.(md|pdf|docx?|pptx?|txt))+$", ""))
    return F.lower(F.when(bare == "", base).otherwise(bare))


def version_of(filename: Column) -> Column:
    """struct(stem, version, extension) of stem__vNN.ext; version null for a file without one."""
    pattern = r"^(.+)__v(\d+)(\.[^./]+)$"
    versioned = filename.rlike(pattern)
    plain = r"^(.*?)(\.[^./]+)?$"
    return F.struct(
        F.when(versioned, F.regexp_extract(filename, pattern, 1)).otherwise(F.regexp_extract(filename, plain, 1)).alias("stem"),
        F.when(versioned, F.regexp_extract(filename, pattern, 2).try_cast("int")).alias("version"),
        F.when(versioned, F.regexp_extract(filename, pattern, 3)).otherwise(F.regexp_extract(filename, plain, 2)).alias("extension"),
    )


def versioned_name(stem: Column, version: Column, extension: Column) -> Column:
    number = version.cast("string")
    return F.concat(stem, F.lit("__v"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number), extension)


def raw_path(path: Column) -> Column:
    """struct(source, directory, stem, version, extension, error) of a raw file's path; version 1 for one without.

    error: why the path is none: an unknown source, a malformed version or no extension.
    """
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/+")
    name = F.element_at(parts, -1)
    v = version_of(name)
    source = parts[0]
    error = (
        F.when(~source.isin("UPLOAD_DATA", "RAW_DATA"), "unknown source").when(F.contains(name, F.lit("__v")) & v["version"].isNull(), "malformed version")
        .when(v["extension"] == "", "missing extension")
    )
    return F.struct(
        source.alias("source"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "/").alias("directory"), v["stem"].alias("stem"),
        F.coalesce(v["version"], F.lit(1)).alias("version"), v["extension"].alias("extension"), error.alias("error"),
    )


def stage_path(folder: str, raw: Column) -> Column:
    """Where a stage keeps its output for a raw file."""
    return F.concat(F.lit(f"{folder.strip('/')}/"), F.regexp_replace(raw, "^/+|/+$", ""), F.lit(".md"))


def subtree_root(root: str) -> tuple[str, list[str]]:
    """A folder below the shared root, and what was changed; one that leaves the root is an error."""
    changed, path = [], root.replace("\\", "/")
    if not path.strip():
        return "", changed
    if path.startswith("/"):
        path = path.lstrip("/")
        changed.append("leading slash removed")
    head, _, rest = path.partition("/")
    if head == "SHARED":
        path = rest
        changed.append("shared prefix removed")
    if "//" in path:
        changed.append("separators collapsed")
    parts: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not parts:
                raise ValueError("the path leaves the shared folder")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts), changed


# -- normal forms -----------------------------------------------------------------------


@arrow("string")
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility form."""
    for t in texts:
        yield t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@arrow("string")
def _decomposed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


@arrow("string")
def unescaped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references of HTML resolved."""
    for t in texts:
        yield t.map(lambda x: None if x is None else html_escapes.unescape(x))


_ENDS = r"^[\s\"'«»“”().,;:—–\-]+|[\s\"'«»“”().,;:—–\-]+$"


def light_name(name: Column) -> Column:
    """A name in compatibility form, on one line, without punctuation at its ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(nfkc(F.coalesce(name, F.lit(""))), r"\s+", " ")), _ENDS, "")


def name_of(name: Column) -> Column:
    """The same in lower case: the key of a dictionary."""
    return F.lower(light_name(name))


def slug(text: Column, size: int = 48) -> Column:
    """Lower-case words joined by hyphens, at most ``size`` signs; ``doc`` for none."""
    t = F.regexp_replace(_decomposed(F.lower(text)), r"[^\p{L}\p{N}_]+", "-")
    trimmed = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    out = trimmed(F.left(trimmed(t), F.lit(size)))
    return F.when(out == "", "doc").otherwise(out)


def transliterated(text: Column) -> Column:
    """Latin letters and digits for Cyrillic text, in lower case; other signs go."""
    t = F.lower(text)
    for letter, latin in _MANY.items():
        t = F.replace(t, F.lit(letter), F.lit(latin))
    return F.regexp_replace(F.translate(t, *_ONE), r"[^\p{L}\p{N}]", "")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


# Endings of Russian words by case and number, in the order in which they are tried.
CASE_ENDINGS = "ами|ями|ого|его|ому|ему|ыми|ими|ах|ях|ов|ев|ая|яя|ою|ею|ый|ий|ой|ем|ом|ую|юю|ы|и|а|я|у|ю|е|о|й|ь"
NUMBER_ENDINGS = "ами|ями|ов|ев|ей|ах|ях|ам|ям|ье|ья|а|я|ы|и|у|ю|е|о|ь|й"


def case_stem(word: Column) -> Column:
    """A word of six letters and more without a Russian case ending, if four letters stay."""
    w, out = F.lower(word), F.lower(word)
    for end in reversed(CASE_ENDINGS.split("|")):
        out = F.when(w.endswith(end) & (F.length(w) - len(end) >= 4), F.left(w, F.length(w) - len(end))).otherwise(out)
    return F.when(F.length(w) < 6, w).otherwise(out)


def phrase_stem(phrase: Column) -> Column:
    """A phrase by the case stems of its words."""
    return F.array_join(F.transform(F.filter(F.split(phrase, r"\s+"), lambda w: w != ""), case_stem), " ")


def number_stem(name: Column) -> Column:
    """A name by its words without endings of case and number, Russian or English; stems under three letters stay whole."""
    words = F.filter(F.split(nfkc(F.lower(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")

    def stem(w: Column) -> Column:
        s = F.when(w.rlike("[а-яё]"), F.regexp_replace(w, f"(?:{NUMBER_ENDINGS})$", "")).otherwise(F.regexp_replace(w, "s$", ""))
        return F.when(F.length(s) >= 3, s).otherwise(w)

    return F.array_join(F.transform(words, stem), " ")


def declension_key(term: Column) -> Column:
    """A single Cyrillic word of six letters and more without up to three last letters, of which five stay; else null."""
    t = F.lower(F.trim(term))
    alone = ~F.contains(t, F.lit(" ")) & t.rlike("[Ѐ-ӿ]") & (F.length(t) >= 6)
    return F.when(alone, F.left(t, F.greatest(F.length(t) - 3, F.lit(5))))


# -- markup -----------------------------------------------------------------------------


def without_markdown(md: Column) -> Column:
    """Plain text of Markdown; the cells of tables stay."""
    steps = [
        (r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`[^`]*`", " "), (r"<[^>]+>", " "),
        (r"(?m)^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$", " "), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*(?:[-*+]|\d+[.)])\s+", ""),
        (r"[*_~]{1,3}", ""), (r"\|", " "), (r"\n{3,}", "\n\n"),
    ]
    for pattern, into in steps:
        md = F.regexp_replace(md, pattern, into)
    return F.regexp_replace(md, r"^\s+|\s+$", "")


def without_tags(html: Column) -> Column:
    """Text of HTML: tags removed, character references resolved."""
    return F.trim(unescaped(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", "")))


def article_body(page: Column) -> Column:
    """Text of the paragraphs after the mark of the article's body, or of the whole page without one."""
    at = F.locate('itemprop="articleBody"', page)
    body = F.when(at > 0, F.substring(page, at, F.length(page))).otherwise(page)
    paragraphs = F.transform(found_all(body, r"(?is)<p[^>]*>(.*?)</p>", 1), lambda p: F.trim(F.regexp_replace(p, "<[^>]+>", "")))
    return unescaped(F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n"))


def from_positions(index: Column) -> Column:
    """Text of an inverted index: map from a word to its positions."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("at"), e["key"].alias("word")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(entries), lambda x: x["word"]), " "), F.lit(""))


def relaxed(query: Column) -> Column:
    """A query without quotes around phrases."""
    return F.trim(F.regexp_replace(query, '"([^"]*)"', "$1"))


def sanitised(query: Column) -> Column:
    """A query without wildcards, on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, "[?*]+", " "), r"\s+", " "))


def verbalised(source: Column, verb: Column, relation: Column, target: Column) -> Column:
    """A relation as a phrase: source, verb, target; without a verb its name between dashes."""
    s, v, r, t = (F.trim(F.coalesce(c, F.lit(""))) for c in (source, verb, relation, target))
    return F.trim(F.when(v != "", F.concat_ws(" ", s, v, t)).otherwise(F.concat_ws(" — ", s, r, t)))


def first_year(text: Column, chars: int = 6000) -> Column:
    """The first year from 1980 to 2029, or null."""
    return F.nullif(F.regexp_extract(F.left(text, F.lit(chars)), r"\b(19[89]\d|20[0-2]\d)\b", 1), F.lit("")).cast("int")


# -- judgements -------------------------------------------------------------------------

# Sources that are trusted, single words too general to be terms, and endings that mark fragments.
TRUSTED = ["seed", "wikidata", "wikipedia", "schwartz_hearst", "contract"]
GENERAL = [
    "extraction", "refinement", "purification", "refining", "treatment", "process", "processing", "method", "material", "separation", "production",
    "converter", "sterilizer", "solution", "recovery", "leaching", "reduction", "oxidation", "product", "system", "device", "unit", "plant",
]
_VERBAL = "(?:ения|ания|ования|ение|ание|енного|енной|ения,)$"
_DANGLING = "(?:ой|ого|его|ым|ыми|ую|ая|ое|ых|ому|ей)$"


def junk_reason(term: Column, sources: Column | None = None) -> Column:
    """Why a term is no term, or null: empty, quotes, a brand's code, one sign, two signs from no trusted source, a general word, a fragment."""
    t = F.trim(F.coalesce(term, F.lit("")))
    words = F.split(t, r"\s+")
    trusted = F.lit(False) if sources is None else F.coalesce(F.arrays_overlap(sources, F.array(*map(F.lit, TRUSTED))), F.lit(False))
    first, last = F.lower(words[0]), F.lower(F.element_at(words, -1))
    several = (F.size(words) >= 2) & t.rlike("[Ѐ-ӿ]")
    return (
        F.when(t == "", "empty").when(t.rlike("[‘’“”«»]"), "smart_quote_fragment").when(t.rlike("^[A-Z][a-zA-Z]+-[A-Z0-9]{1,3}$"), "brand_code")
        .when((F.size(words) == 1) & (F.length(t) == 1), "single_char").when((F.size(words) == 1) & (F.length(t) <= 2) & ~trusted, "bare_short_token")
        .when((F.size(words) == 1) & F.lower(t).isin(*GENERAL), "generic_english").when(several & first.rlike(_VERBAL) & (F.length(first) >= 6), "ru_verbal_fragment")
        .when(several & last.rlike(_DANGLING) & (F.length(last) >= 5) & ~last.rlike("(?:ость|ство)$"), "dangling_modifier")
    )


def junk_form(term: Column) -> Column:
    """Whether a form is junk whatever its source."""
    t = F.trim(F.coalesce(term, F.lit("")))
    return (t == "") | t.rlike("[‘’“”]") | t.rlike("^[A-Z][a-zA-Z]+-[A-Z0-9]{1,3}$")


def junk_entity(text: Column, stop: list[str]) -> Column:
    """Whether an entity is a stop word or shorter than three letters."""
    low = F.lower(F.trim(text))
    return (F.length(low) < 3) | low.isin(*stop)


# Countries that stand for no expansion, and signs and words of formulas.
COUNTRIES = [
    "канада", "перу", "армения", "армении", "россия", "россии", "китай", "китая", "норвегия", "норвегии", "финляндия", "австралия", "чили", "замбия", "конго",
    "индонезия", "бразилия", "юар", "сша", "canada", "peru", "armenia", "russia", "china", "norway", "finland", "australia", "chile", "zambia", "congo", "brazil",
]


def junk_abbreviation(acronym: Column, expansion: Column) -> Column:
    """Whether an expansion is its acronym, a country, or a piece of a formula, or the acronym one letter and a slash."""
    a, e = F.trim(acronym), F.trim(expansion)
    formula = e.rlike("[αβγδθλμπσφω∑∫√±×÷]") | e.rlike(r"(?iu)\b(sin|cos|tan|log|exp|lim|max|min)\b")
    slash = F.contains(a, F.lit("/")) & (F.length(F.replace(a, F.lit("/"), F.lit(""))) <= 1)
    return (F.lower(a) == F.lower(e)) | F.lower(e).isin(*COUNTRIES) | formula | slash


def refuses(answer: Column, markers: list[str], within: int = 150) -> Column:
    """Whether an answer opens with a refusal."""
    head = F.lower(F.left(answer, F.lit(within)))
    return F.greatest(F.lit(False), *(F.contains(head, F.lit(m.lower())) for m in markers))


# Fixed value: phrases by which an answer says that there are no data.
NO_DATA = (
    "(?iu)нет данных|не найдено|ничего не найдено|не содержит|отсутству|не удалось найти|нет информации|данных нет|не нашл|в корпусе нет|нет в корпусе|не располага"
    "|no data|not found|no relevant|does ?n.?t contain|not contain|no information"
)


def says_no_data(answer: Column) -> Column:
    return answer.rlike(NO_DATA)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based identifier (version 5) of a name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
