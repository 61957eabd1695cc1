"""Names of persons as they occur in catalogues: cleaning, keys, classification.

Every function takes and returns Columns and stays inside Spark SQL. A null name is treated as an
empty one unless a function says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Words, marks and patterns that decide results.

NULL_WORDS = ["", "na", "nan", "null", "none", "-"]

PUNCTUATION = ".,;:'\"·´`-_()"

MOJIBAKE_ALONE = "ÐÃ"
MOJIBAKE_MARKS = "ÐÃÅãåçêëîíì"

NOISE = [
    "arranged from", "arranged by", "arranged", "attributed to", "attrib.", "attr.", "arr.", "arr ", " by ", "by ", "written by", "music by",
    "original music", "tune is", " page ", "tome", "feat", "solo ", "&", "/", "[",
]

FORBIDDEN_WORDS = [
    "song", "music", "track", "album", "obras", "works", "version", "traditional", "anonymous", "anonimo", "pop", "rock", "jazz", "bluegrass",
    "symphony", "concerto", "sonata", "part", "vol", "op", "arr", "arranged", "tune", "melody", "chorus", "verse", "page", "tome", "solo", "duet",
    "book", "movement", "piece",
]
PARTICLES = ["de", "del", "van", "von", "di", "da", "der", "den", "la", "le", "y", "st"]

NAME_FOLLOWS = ["attributed to ", "attrib. ", "attr. ", "arranged by ", "arranged from "]

ANONYMOUS_IN_CANDIDATES = [
    "anon", "anon.", "anonymous", "trad", "trad.", "traditional", "tradicional", "traditionell", "traditionel", "traditionnel", "traditionnelle",
    "anonim", "anonimo", "anônimo", "attrib.", "attributed", "attrib", "unknown", "author unknown", "urheber unbekannt", "urheber unbek.", "na",
    "n/a", "n.a.", "none", "composer", "unattributed", "moderate", "unbekannt",
]
ANONYMOUS_IN_MATCHING = [
    "anon", "anon.", "anonymous", "anonymus", "anonimo", "anónimo", "trad", "trad.", "traditional", "traditionnel", "tradicional", "traditionell",
    "unattributed", "unknown", "author unknown", "urheber unbekannt", "urheber unbek.", "na", "n/a", "n.a.", "none", "unknown composer", "composer",
]
ANONYMOUS_IN_AUTHORITY = [
    "anon", "anon.", "anonymous", "trad", "trad.", "traditional", "attrib.", "attributed", "attrib", "unknown", "author unknown",
    "urheber unbekannt", "urheber unbek.",
]
ANONYMOUS_PREFIX = "urheber unbekannt"

QUALIFIERS = [
    r"^after\b", r"^arr\.?\b", r"^attr\.?\b", r"^attributed to\b", r"^probably\b", r"^possibly\b", r"^doubtful\b", r"^harmonisat",
    r"^harmonization of\b", r"^based on\b", r"^from\b", r"^par\b", r"^nach\b", r"^by\b",
]
NO_PERSON = [
    r"\b(symphony|symphonie|sonata|concerto|quartet|quintet|trio|duet|song|tune|melody|march|dance|nocturne|prelude|fugue|oratorio|requiem|mass|opera|operetta|chorale)\b",
    r"\b(band|orchestra|ensemble|chorus|choir|consort|capella)\b",
    r"\b(book|manuscript|handschrift|collection|codex|libro|chansonnier|anthology)\b",
    r"\b(sioux|thysius|vermell de montserrat|schemellis)\b",
    r"^bij een", r"^hand of ", r"^in hand\b", r"\bin hand [a-z]\b", r"untitled", r"\bin ms\b", r"\bms\.?\b", r"^old scotch", r"very old scotch",
    r"\bscotch\b|\bsthrewpence\b", r"^trad\b", r"\btrad\.?\b", r"traditional (irish|shetland|folk|scottish|scot|welsh)",
    r"\b(compiled|collected|assembled|gathered|selected|arranged) by\b",
    r"\b(manuscript|scribe|copist|compiler|provenance)\b", r"^de prins frans",
    r"\b(hornpipe|reel|jig|strathspey|waltz|polka|galop)\b",
]

WORK_TITLES = (
    r"Anexo:|Composiciones de|Concierto|Variaciones sobre|Estudios sobre|Recital|\([^)]*(Mozart|Bach|Chopin|Beethoven)[^)]*\)|Obra|Sonata|Sinfon"
    r"|Cuarteto|Preelud|Nocturne|Marcha|Danza|Obertura|Réquiem|Oratorio|Mis"
)

ATTRIBUTION_TYPES = [
    ("ANONIMA", r"\b(anon|anonymous|anonimo|anónimo)\b"),
    ("DESCONOCIDO", r"\b(unknown|unbekannt|desconocido|composer unknown|autor desconocido)\b"),
    ("TRADICIONAL", r"\b(traditional|trad|tradicional|traditionell|traditionnel|folk)\b"),
    ("POPULAR", r"\b(popular)\b"),
    ("ATRIBUIDA", r"\b(attrib|attributed|atribuida|atribuido)\b"),
]

GENERIC_PREFIXES = ["op", "opus", "no", "nos"]

CORRECT, INCORRECT, NOT_REVIEWED = "correct", "incorrect", "not_reviewed"
# ----------------------------------------------------------- end of fixed values


def _bare(sign: str) -> str:
    """The compatibility form of a character without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c))


def _foldable() -> tuple[str, str]:
    """Characters whose bare form is one other character, and those."""
    pairs = [(chr(code), _bare(chr(code))) for code in range(0x80, 0x2000) if len(_bare(chr(code))) == 1 and _bare(chr(code)) != chr(code)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: From the Unicode tables of this Python.
ACCENTED, BARE = _foldable()
#: Latin letters, ligatures and signs whose bare form is several characters.
SPELLED_OUT = {chr(code): _bare(chr(code)) for code in (*range(0x80, 0x250), *range(0xFB00, 0xFB07), 0x2026, 0x2116) if len(_bare(chr(code))) > 1}


#: Where one of these may be found: few ranges, as a set of single characters is slow.
_SIGNS = "[¼-¾Ĳ-ŉǄ-ǌǱ-ǳ…№ﬀ-ﬆ]"
#: The white space of Unicode, as `(?U)\s` has it.
WHITE_SPACE = "\t\n\v\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACES = rf"(?U)[\s{re.escape(PUNCTUATION)}]+"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode white space included."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_accents(c: Column) -> Column:
    """Letters without their accents, ligatures spelled out; plain ASCII passes untouched."""

    def spelled(bare: Column) -> Column:
        out = bare
        for sign, letters in SPELLED_OUT.items():
            out = F.replace(out, F.lit(sign), F.lit(letters))
        return F.when(bare.rlike(_SIGNS), out).otherwise(bare)

    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(let(F.translate(c, ACCENTED, BARE), spelled), r"\p{M}+", "")).otherwise(c)


def fold_key(c: Column) -> Column:
    """Key under which texts are equal whatever their case, accents and trailing blanks. Null stays null."""
    return F.rtrim(F.lower(strip_accents(c)))


def clean_null(c: Column) -> Column:
    """Trimmed; the words for a missing value become null."""
    bare = strip(c)
    return F.when(~F.lower(bare).isin(NULL_WORDS), bare)


def clip(c: Column, n: int) -> Column:
    """Trimmed, at most n characters; blank becomes null."""
    return F.nullif(F.left(strip(c), F.lit(n)), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Key of an alias: no accents, lower case, common punctuation as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text(c))), _SPACES, " "))


def norm_light(c: Column) -> Column:
    """Trimmed, single blanks, lower case; accents and punctuation stay."""
    return F.lower(F.regexp_replace(strip(text(c)), r"(?U)\s+", " "))


def clean_name(c: Column) -> Column:
    """Letters, hyphens and single blanks only; neither at the ends."""
    dashed = F.replace(F.replace(text(c), F.lit("–"), F.lit("-")), F.lit("—"), F.lit("-"))
    return F.btrim(F.regexp_replace(dashed, r"[^\p{L}\-]+", " "), F.lit(" -"))


_MOJIBAKE = f"[\ufffd{MOJIBAKE_ALONE}]|[{MOJIBAKE_MARKS}][^{MOJIBAKE_MARKS}]*+[{MOJIBAKE_MARKS}]"


def is_mojibake(c: Column) -> Column:
    """Whether UTF-8 was read as Latin-1: a replacement character, a sure mark, or two marks."""
    return text(c).rlike(_MOJIBAKE)


def _any(c: Column, tests: list[Column]) -> Column:
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def classify_name(c: Column) -> Column:
    """correct, incorrect or not_reviewed, by the form of the name alone."""
    return let(strip(text(c)), _form_of)


def _form_of(s: Column) -> Column:
    tokens = F.filter(F.split(s, r"[\s,]+"), lambda t: t != "")
    noise = let(F.lower(s), lambda lower: _any(lower, [lower.contains(p) for p in NOISE]))
    wrong = (F.length(s) < 2) | ~s.rlike(r"\p{L}") | is_mojibake(s) | noise | s.rlike("[0-9]")
    plain = s.rlike(r"^[A-Za-zÀ-ÿ'.\-, ]+$") & (F.size(tokens) >= 2)
    return F.when(wrong, INCORRECT).when(plain, CORRECT).otherwise(NOT_REVIEWED)


def is_suspicious(c: Column) -> Column:
    return classify_name(c) != CORRECT


def is_title(c: Column) -> Column:
    """Whether every run of letters begins with a capital and goes on in lower case."""
    return c.rlike(r"^\P{L}*(?:[\p{Lu}\p{Lt}]\p{Ll}*(?:\P{L}+|$))+$")


def _is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


_WORDS, _FIRST = r"(?U)\s+", 40
#: The tokens of a text that can score: those with a capital, and particles.
_SCORING = rf"(?U)(?<!\S)(?:[^\s\p{{Lu}}\p{{Lt}}]*+[\p{{Lu}}\p{{Lt}}]\S*+|(?:{'|'.join(PARTICLES)})(?!\S))"


def validate_name(c: Column) -> Column:
    """struct(valid, score, reason): whether a name has the form of a person's name."""
    return let(F.regexp_replace(strip(text(c)), "([a-z])([A-Z])", "$1 $2"), _judge)


def _points(t: Column) -> Column:
    upper = _is_upper(t)
    return F.when((F.length(t) == 1) & upper, 1.0).when(is_title(t), 1.5).when(upper, 1.2).when(F.lower(t).isin(PARTICLES), 0.8).otherwise(0.0)


def _sum(points: Column) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, x: a + x)


def _forbidden(s: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(s), _WORDS), F.array(*map(F.lit, FORBIDDEN_WORDS)))


def _lone(s: Column) -> Column:
    return is_title(s) & ~_forbidden(s) & (F.length(s) > 1) & ~s.rlike(r"^\p{Nd}+$")


def _judge(s: Column) -> Column:
    """The verdict on a text without blanks at its ends. Tokens that can't score are not looked at one by one."""

    def verdict(valid: bool, points: Column, reason: str) -> Column:
        return F.struct(F.lit(valid).alias("valid"), points.cast("double").alias("score"), F.lit(reason).alias("reason"))

    none = F.lit(0.0)

    def by_points(p: Column, n: Column) -> Column:
        return let(
            _sum(p),
            lambda score: F.when((n == 2) & F.exists(p, lambda x: x >= 1.0) & (score >= 2.0), verdict(True, score, "two words"))
            .when(score >= 2.5, verdict(True, score, "person"))
            .otherwise(verdict(False, score, "score too low")),
        )

    def by_size(n: Column) -> Column:
        return (
            F.when((n == 1) & _lone(s), verdict(True, F.lit(0.7), "single surname"))
            .when(n == 1, verdict(False, none, "single word"))
            .when(_forbidden(s), verdict(False, none, "forbidden word"))
            .otherwise(let(F.transform(F.regexp_extract_all(s, F.lit(_SCORING), F.lit(0)), _points), lambda p: by_points(p, n)))
        )

    return F.when(s == "", verdict(False, none, "empty")).otherwise(let(F.size(F.split(s, _WORDS, 3)), by_size))


def _is_valid(c: Column) -> Column:
    """Whether validate_name finds a text valid. No token takes from the score, so where the first ones reach it the rest are left."""

    def of(s: Column) -> Column:
        first = F.slice(F.split(s, _WORDS, _FIRST + 1), 1, _FIRST)
        return let(
            F.size(F.split(s, _WORDS, 3)),
            lambda n: F.when((s == "") | (n == 1), (s != "") & _lone(s))
            .when(_forbidden(s), False)
            .when((n > 2) & (_sum(F.transform(first, _points)) >= 2.5), True)
            .otherwise(_judge(s)["valid"]),
        )

    return let(F.regexp_replace(strip(text(c)), "([a-z])([A-Z])", "$1 $2"), of)


def _marked_part(s: Column) -> Column:
    """What the marks in a text point to as a name; null or blank without a mark, blank if nothing is there."""
    arranged, last_by = r"(?iuUs)^(.*?)\barr(?:\.|anged)", r"(?iuUs)^.*\bby\b(.*)$"

    def pointed(lower: Column) -> Column:
        after = [F.when(F.instr(lower, m) > 0, F.substr(s, F.instr(lower, m) + len(m))) for m in NAME_FOLLOWS]
        before = F.when((lower.contains("arr.") | lower.contains("arranged")) & s.rlike(arranged), F.regexp_extract(s, arranged, 1))
        return F.coalesce(*after, before, F.when(lower.contains("by"), F.regexp_extract(s, last_by, 1)))

    return let(F.lower(s), pointed)


_AROUND = " []()\t.:"


def extract_name(c: Column, person: Callable[[Column], Column] | None = None) -> Column:
    """A plausible name inside a noisy text, or null.

    `person`, a vectorised recogniser, is asked where no mark is found; leave it out and it is skipped.
    """
    s = strip(text(c))
    marked = F.btrim(F.nullif(let(s, _marked_part), F.lit("")), F.lit(_AROUND))
    if person is not None:
        marked = F.coalesce(marked, person(s))
    found = F.coalesce(*(let(clean_name(x), lambda o: F.when((o != "") & _is_valid(o), o)) for x in (marked, s)))
    return F.when((s != "") & ~is_mojibake(s), found)


def is_anonymous(c: Column, words: list[str] = ANONYMOUS_IN_MATCHING, strip_marks: bool = True) -> Column:
    low = strip(F.lower(text(c)))
    if strip_marks:
        low = F.regexp_replace(low, r"[?¿¡!.]+\s*$", "")
    return low.isin(words) | low.startswith(ANONYMOUS_PREFIX)


def name_key(c: Column, anonymous: list[str] = ANONYMOUS_IN_AUTHORITY) -> Column:
    """Initials and surname; `anonymous` for such names; '' without a Latin letter."""

    def keyed(tokens: Column) -> Column:
        n = F.size(tokens)
        joined = (n > 1) & (F.get(tokens, n - 2) == "o")
        surname = F.when(joined, F.concat(F.lit("o"), F.get(tokens, n - 1))).otherwise(F.get(tokens, n - 1))
        given = F.slice(tokens, F.lit(1), F.greatest(F.when(joined, n - 2).otherwise(n - 1), F.lit(0)))
        initials = F.array_join(F.transform(given, lambda t: F.left(t, F.lit(1))), "")
        return F.when(n == 0, F.lit("")).otherwise(F.trim(F.concat_ws(" ", initials, surname)))

    def of(low: Column) -> Column:
        key = let(F.regexp_extract_all(low, F.lit("([a-zà-ÿ]+)"), F.lit(1)), keyed)
        return F.when(low.isin(anonymous) | low.startswith(ANONYMOUS_PREFIX), "anonymous").otherwise(key)

    return let(F.replace(F.replace(F.lower(strip(text(c))), F.lit("'")), F.lit("’")), of)


def candidate_label(c: Column) -> Column:
    """struct(label, verdict) of an attribution: real, review, mojibake, no_persona or qualifier."""

    def label(name: str, verdict: str) -> Column:
        return F.struct(F.lit(name).alias("label"), F.lit(verdict).alias("verdict"))

    def is_bare(words: Column) -> Column:
        return (F.size(words) == 0) | F.forall(words, lambda w: F.length(w) <= 1) | (F.length(F.array_join(words, "")) <= 2)

    def by_words(low: Column) -> Column:
        """The number of the first rule of the lower-cased text that holds, 0 if none does."""
        named = low.isin(ANONYMOUS_IN_CANDIDATES) | low.startswith(ANONYMOUS_PREFIX)
        return F.when(named, 1).when(low.rlike("(?uU)" + "|".join(QUALIFIERS)), 2).when(low.rlike("(?uU)" + "|".join(NO_PERSON)), 3).otherwise(0)

    def of(s: Column) -> Column:
        bare = let(F.filter(F.split(clean_name(s), " "), lambda w: w != ""), is_bare)
        by_form = let(_form_of(s), lambda f: F.when(f == CORRECT, label("real", CORRECT)).when(f == INCORRECT, label("no_persona", INCORRECT)).otherwise(label("review", NOT_REVIEWED)))
        return let(
            by_words(F.lower(s)),
            lambda rule: F.when(rule == 1, label("no_persona", INCORRECT))
            .when(is_mojibake(s), label("mojibake", INCORRECT))
            .when(rule == 2, label("qualifier", INCORRECT))
            .when((rule == 3) | s.rlike('^["“]|["”]$'), label("no_persona", INCORRECT))
            .when(bare, label("no_persona", INCORRECT))
            .otherwise(by_form),
        )

    return let(strip(text(c)), of)


def is_person_entry(name: Column, entity_id: Column, works: str = WORK_TITLES) -> Column:
    s = strip(text(name))
    return (s != "") & (text(entity_id) != "") & ~s.rlike(f"(?iu){works}")


def attribution_type(c: Column) -> Column:
    """The first kind of attribution whose pattern is found; null without one."""
    found = None
    for kind, pattern in ATTRIBUTION_TYPES:
        hit = text(c).rlike(f"(?iuU){pattern}")
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    return found


def display_name_from_attribution(c: Column) -> Column:
    """Without a year at the end and without parentheses."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text(c)), r"\s+\d{3,4}\s*$", ""), r"\([^)]*\)", ""))


def extract_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text(c), r"(?uU)\b(1[89]\d\d|20\d\d)\b", 1), F.lit("")).cast("int")


def year_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit(""))


def parse_list(c: Column) -> Column:
    """Items of a literal list `['a', "b"]`, else of a text cut at `;` and `,`; no blanks."""
    s = clean_null(c)
    quoted = F.regexp_extract_all(s, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    inside = F.filter(F.transform(quoted, lambda q: F.substr(q, F.lit(2), F.length(q) - 2)), lambda q: q != "")
    cut = F.filter(F.transform(F.split(s, "[;,]"), strip), lambda q: q != "")
    return F.coalesce(F.when(s.rlike(r"(?s)^\[.*\]$") & (F.size(quoted) > 0), inside).when(s == "[]", F.array().cast("array<string>")).otherwise(cut), F.array().cast("array<string>"))


def to_int(c: Column) -> Column:
    return clean_null(c).try_cast("int")


def catalogue_prefix(c: Column) -> Column:
    """Letters before a full stop, or before blanks and a digit; null for general ones."""
    s = strip(text(c))
    found = F.coalesce(
        F.nullif(F.regexp_extract(s, r"^([A-Za-z]+)\.", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"^([A-Za-z]+)\s+\d", 1), F.lit(""))
    )
    return let(found, lambda f: F.when(~F.lower(f).isin(GENERIC_PREFIXES), f))


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


VERDICT = "valid: BOOLEAN, score: DOUBLE, reason: STRING"


def _let_sql(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _strip_sql(x: str) -> str:
    return f"btrim(coalesce({x}, ''), {_quoted(WHITE_SPACE)})"


def _clean_sql(x: str) -> str:
    return f"btrim(regexp_replace(replace(replace(coalesce({x}, ''), '–', '-'), '—', '-'), {_quoted(r'[^\p{L}\-]+')}, ' '), ' -')"


def _in_sql(x: str, values: list[str]) -> str:
    return f"{x} IN ({', '.join(map(_quoted, values))})"


def _validate_sql(x: str, valid_only: bool = False) -> str:
    """`validate_name` in SQL, of an expression, or only whether it is valid."""

    def is_title(t: str) -> str:
        return f"rlike({t}, {_quoted(r'^\P{L}*(?:[\p{Lu}\p{Lt}]\p{Ll}*(?:\P{L}+|$))+$')})"

    def is_upper(t: str) -> str:
        return f"(rlike({t}, {_quoted(r'\p{Lu}')}) AND NOT rlike({t}, {_quoted(r'[\p{Ll}\p{Lt}]')}))"

    def verdict(valid: str, score: str, reason: str) -> str:
        return f"named_struct('valid', {valid}, 'score', CAST({score} AS DOUBLE), 'reason', '{reason}')"

    words = _quoted(_WORDS)
    points = f"CASE WHEN length(t) = 1 AND {is_upper('t')} THEN 1.0D WHEN {is_title('t')} THEN 1.5D WHEN {is_upper('t')} THEN 1.2D WHEN {_in_sql('lower(t)', PARTICLES)} THEN 0.8D ELSE 0.0D END"
    scored = f"transform(regexp_extract_all(k, {_quoted(_SCORING)}, 0), t -> {points})"
    first = f"aggregate(transform(slice(split(k, {words}, {_FIRST + 1}), 1, {_FIRST}), t -> {points}), 0.0D, (a, x) -> a + x)"
    forbidden = f"arrays_overlap(split(lower(k), {words}), array({', '.join(map(_quoted, FORBIDDEN_WORDS))}))"
    lone = f"({is_title('k')} AND NOT {forbidden} AND length(k) > 1 AND NOT rlike(k, {_quoted(r'^\p{Nd}+$')}))"
    by_points = (
        f"CASE WHEN n = 2 AND exists(p, x -> x >= 1) AND s >= 2 THEN {verdict('true', 's', 'two words')} WHEN s >= 2.5D THEN {verdict('true', 's', 'person')}"
        f" ELSE {verdict('false', 's', 'score too low')} END"
    )
    by_size = (
        f"CASE WHEN n = 1 AND {lone} THEN {verdict('true', '0.7D', 'single surname')} WHEN n = 1 THEN {verdict('false', '0', 'single word')}"
        f" WHEN {forbidden} THEN {verdict('false', '0', 'forbidden word')}"
        f" ELSE {_let_sql(scored, 'p', _let_sql('aggregate(p, 0.0D, (a, x) -> a + x)', 's', by_points))} END"
    )
    judged = f"CASE WHEN k = '' THEN {verdict('false', '0', 'empty')} ELSE {_let_sql(f'size(split(k, {words}, 3))', 'n', by_size)} END"
    if valid_only:
        short = f"CASE WHEN k = '' OR n = 1 THEN k <> '' AND {lone} WHEN {forbidden} THEN false WHEN n > 2 AND {first} >= 2.5D THEN true ELSE {judged}.valid END"
        judged = _let_sql(f"size(split(k, {words}, 3))", "n", short)
    return _let_sql(f"regexp_replace({_strip_sql(x)}, '([a-z])([A-Z])', '$1 $2')", "k", judged)


def _extract_sql(x: str) -> str:
    """`extract_name` in SQL, without a recogniser."""
    arranged, last_by = r"(?iuUs)^(.*?)\barr(?:\.|anged)", r"(?iuUs)^.*\bby\b(.*)$"
    after = [f"CASE WHEN instr(l, {_quoted(m)}) > 0 THEN substr(s, instr(l, {_quoted(m)}) + {len(m)}) END" for m in NAME_FOLLOWS]
    before = f"CASE WHEN (contains(l, 'arr.') OR contains(l, 'arranged')) AND rlike(s, {_quoted(arranged)}) THEN regexp_extract(s, {_quoted(arranged)}, 1) END"
    by = f"CASE WHEN contains(l, 'by') THEN regexp_extract(s, {_quoted(last_by)}, 1) END"
    pointed = _let_sql("lower(s)", "l", f"coalesce({', '.join([*after, before, by])})")
    marked = f"btrim(nullif({pointed}, ''), {_quoted(_AROUND)})"
    tried = [_let_sql(_clean_sql(v), "o", f"CASE WHEN o <> '' AND {_validate_sql('o', valid_only=True)} THEN o END") for v in (marked, "s")]
    return _let_sql(_strip_sql(x), "s", f"CASE WHEN s <> '' AND NOT rlike(s, {_quoted(_MOJIBAKE)}) THEN coalesce({', '.join(tried)}) END")


def _key_sql(x: str) -> str:
    """`name_key` in SQL."""
    joined = "(size(k) > 1 AND get(k, size(k) - 2) = 'o')"
    surname = f"CASE WHEN {joined} THEN concat('o', get(k, size(k) - 1)) ELSE get(k, size(k) - 1) END"
    given = f"slice(k, 1, greatest(CASE WHEN {joined} THEN size(k) - 2 ELSE size(k) - 1 END, 0))"
    key = f"CASE WHEN size(k) = 0 THEN '' ELSE trim(concat_ws(' ', array_join(transform({given}, t -> left(t, 1)), ''), {surname})) END"
    of_tokens = _let_sql("regexp_extract_all(low, '([a-zà-ÿ]+)', 1)", "k", key)
    body = f"CASE WHEN {_in_sql('low', ANONYMOUS_IN_AUTHORITY)} OR startswith(low, {_quoted(ANONYMOUS_PREFIX)}) THEN 'anonymous' ELSE {of_tokens} END"
    return _let_sql(f"replace(replace(lower({_strip_sql(x)}), {_quoted(chr(39))}), '’')", "low", body)


def register_functions(spark: SparkSession) -> list[str]:
    """Name functions as temporary SQL functions: expressions that Catalyst inlines, no Python."""
    spelled = "b"
    for sign, letters in SPELLED_OUT.items():
        spelled = f"replace({spelled}, {_quoted(sign)}, {_quoted(letters)})"
    bare = _let_sql(f"translate(v, {_quoted(ACCENTED)}, {_quoted(BARE)})", "b", f"CASE WHEN rlike(b, {_quoted(_SIGNS)}) THEN {spelled} ELSE b END")
    plain = _let_sql("coalesce(x, '')", "v", rf"CASE WHEN rlike(v, '[^\\x00-\\x7F]') THEN regexp_replace({bare}, '\\p{{M}}+', '') ELSE v END")
    wrong = " OR ".join(["length(s) < 2", r"NOT rlike(s, '\\p{L}')", f"rlike(s, {_quoted(_MOJIBAKE)})", "rlike(s, '[0-9]')"])
    noise = _let_sql("lower(s)", "l", " OR ".join(f"contains(l, {_quoted(p)})" for p in NOISE))
    form = (
        rf"CASE WHEN {wrong} OR {noise} THEN 'incorrect' WHEN rlike(s, '^[A-Za-zÀ-ÿ\'.\\-, ]+$') AND size(filter(split(s, '[\\s,]+'), t -> t <> '')) >= 2"
        " THEN 'correct' ELSE 'not_reviewed' END"
    )
    generic = f"CASE WHEN lower(p) NOT IN ({', '.join(map(_quoted, GENERIC_PREFIXES))}) THEN nullif(p, '') END"
    bodies = {
        "normalize_name": ("STRING", f"trim(regexp_replace(lower({plain}), {_quoted(_SPACES)}, ' '))"),
        "clean_name": ("STRING", _clean_sql("x")),
        "is_mojibake": ("BOOLEAN", f"rlike(coalesce(x, ''), {_quoted(_MOJIBAKE)})"),
        "classify_name": ("STRING", _let_sql(_strip_sql("x"), "s", form)),
        "catalogue_prefix": ("STRING", _let_sql(rf"regexp_extract({_strip_sql('x')}, '^([A-Za-z]+)(?:[.]|\\s+[0-9])', 1)", "p", generic)),
    }
    bodies |= {"validate_name": (f"STRUCT<{VERDICT}>", _validate_sql("x")), "extract_name": ("STRING", _extract_sql("x")), "name_key": ("STRING", _key_sql("x"))}
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    return list(bodies)
