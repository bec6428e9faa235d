"""Quality rules: line-first cleaning, in DataFrame functions only.

Every line of a text is judged by itself (punctuation, navigation, boilerplate), the lines
that fail are taken out, and a document is rejected when its base figures are poor or when
too much of it has gone. No row meets another, so the plan is one scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.durable import pick

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Endings of a sentence, separators of menus, and what boilerplate says.
ENDINGS = [".", "!", "?", "…", ":", ";", '"', "'", ")", "]", "”", "’", "»", "。", "！", "？"]
SEPARATORS = "|»›•·"
# Navigation and boilerplate are in English, German, French and Spanish, in lower case.
NAVIGATION = [
    "home|menu|search|log ?in|sign ?in|sign ?up|subscribe|next|previous|share|read more|contact( us)?|about( us)?|back to top|skip to content",
    "startseite|menü|suche|anmelden|registrieren|abonnieren|weiter|zurück|teilen|mehr lesen|kontakt|über uns|nach oben|zum inhalt",
    "accueil|recherche|connexion|inscription|suivant|précédent|partager|lire la suite|à propos|haut de page|aller au contenu",
    "inicio|menú|buscar|iniciar sesión|registrarse|suscribirse|siguiente|anterior|compartir|leer más|contacto|sobre nosotros|volver arriba|ir al contenido",
]
LONGEST_NAVIGATION = 25
LINKS = r"https?://|www\."
BOILERPLATE = [
    "lorem ipsum|enable javascript|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|licensed under|released under",
    "javascript aktivieren|cookie-richtlinie|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|lizenziert unter|veröffentlicht unter der",
    "activer javascript|politique de confidentialité|gestion des cookies|conditions d.utilisation|mentions légales|tous droits réservés|sous licence",
    "activar javascript|política de privacidad|política de cookies|condiciones de uso|aviso legal|todos los derechos reservados|bajo licencia|bajo la licencia",
]


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules.

    ``symbol_percent``: a line with a larger share of ``#*$%&|<>`` has no punctuation but
    litter; ``min_separators``: so many separators, at least one to each four pieces, make
    a line a menu; ``bare_words``: a line of so many pieces needs no sentence ending (code,
    headings, cut lines go only when shorter); ``boilerplate_words``: a phrase of boilerplate
    fails a line of so many pieces at most, not a paragraph that has it; ``link_percent``: a
    line with a larger share of links is navigation; ``max_lost_percent``: documents that lose a
    larger share of their word characters are rejected; ``min_words`` and
    ``max_repeat_percent`` are the base limits.
    """

    symbol_percent: int = 10
    min_separators: int = 3
    bare_words: int = 50
    boilerplate_words: int = 30
    link_percent: int = 25
    max_lost_percent: int = 50
    min_words: int = 50
    max_repeat_percent: int = 50


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def _count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(_without(c, chars))


def _any_of(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "|^]\\-$" else c for c in chars) + "]"


def _navigation() -> str:
    return f"^({'|'.join(NAVIGATION)})[.!:]?$"


def _line_stays(t: Column, rules: LineRules) -> Column:
    """Whether a trimmed line stays. Cheap tests stand before those that count characters."""
    pieces = _count(t, " \t") + 1
    separators = _count(t, SEPARATORS)
    punctuated = F.right(t, F.lit(1)).isin(ENDINGS) | (pieces >= rules.bare_words)
    littered = t.rlike(_any_of(SYMBOLS)) & (_count(t, SYMBOLS) * 100 > F.length(t) * rules.symbol_percent)
    menu = t.rlike(_any_of(SEPARATORS)) & (separators >= rules.min_separators) & (separators * 4 >= pieces)
    small = F.lower(t)
    menu = menu | ((F.length(t) <= LONGEST_NAVIGATION) & (pieces <= 4) & small.rlike(_navigation()))
    menu = menu | (t.rlike(LINKS) & (F.regexp_count(t, F.lit(LINKS)) * 100 > pieces * rules.link_percent))
    boilerplate = (pieces <= rules.boilerplate_words) & small.rlike("|".join(BOILERPLATE))
    return (t == "") | (punctuated & ~littered & ~menu & ~boilerplate)


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), carry: dict[str, str] | None = None) -> DataFrame:
    """Judge and clean every document; one row out per row in.

    Columns: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lines_removed, clean_text, and the columns of ``carry`` (new name to
    old name), which let a caller keep others.

    Words are runs of anything but space and TAB to CR. A null text counts as having no
    words: it fails the base rules and its clean_text is empty. An empty text does the
    same. Null, repeated and tied ids pass through unchanged, since nothing is grouped; an
    empty table gives an empty table; other columns don't matter, whatever their names.
    Three-word windows are told apart by 64-bit hashes within one document.
    """
    carry = carry or {}
    d = pick(df, _id=id_col, _text=text_col, **{f"_carry_{k}": v for k, v in carry.items()})
    kept_on = ["_id", *[f"_carry_{k}" for k in carry]]
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    d = d.select(*kept_on, text.alias("_text"))
    trimmed = F.btrim("_text", F.lit(SPACE))
    d = d.select(
        *kept_on,
        "_text",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")).alias("_words"),
        F.transform(F.split("_text", "\n"), lambda x: F.struct(x.alias("l"), F.btrim(x, F.lit(SPACE)).alias("t"))).alias("_lines"),
    )
    n = F.size("_words")
    threes = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    lined = F.filter("_lines", lambda x: x["t"] != "")["l"]
    symbols = F.when(F.col("_text").rlike(_any_of(SYMBOLS)), _count(F.col("_text"), SYMBOLS)).otherwise(0)
    d = d.select(
        *kept_on,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.size("_lines").alias("_n_lines"),
        lined.alias("_lined"),
        F.filter("_lines", lambda x: _line_stays(x["t"], rules))["l"].alias("_clean"),
        F.when(n >= 4, F.slice(threes, 1, n - 2)).alias("_threes"),
    )
    # Only documents with a repeated window are sorted: (window, place), then neighbours.
    repeats = F.size(F.array_distinct("_threes")) < F.size("_threes")
    d = d.select(
        *kept_on,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lined") - F.size(F.array_distinct("_lined"))).cast("long").alias("n_dup_lines"),
        F.array_join("_clean", "\n").alias("clean_text"),
        (F.col("_n_lines") - F.size("_clean")).cast("long").alias("lines_removed"),
        F.when(repeats, F.sort_array(F.transform("_threes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"),
    )
    beside = lambda x, i: F.coalesce(F.get("_sorted", i)["h"] == x["h"], F.lit(False))
    same = lambda x, i: beside(x, i - 1) | beside(x, i + 1)
    places = F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["total"] + p + 3 - F.greatest(p, a["end"])).alias("total"), (p + 3).alias("end"))
    repeated = F.when(F.col("_sorted").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(places, start, step, lambda a: a["total"]))
    d = d.withColumn("n_repeat_words", repeated).drop("_sorted")
    d = d.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent))
    lost = F.when(F.col("lines_removed") == 0, 0).otherwise(F.col("word_chars") - F.length(_without(F.col("clean_text"), SPACE)))
    kept = ~F.col("base_failed") & (lost * 100 <= F.col("word_chars") * rules.max_lost_percent)
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # A generator of one row: a filter on ``kept`` stays above it. Pushed below, it would put
    # the steps into each other, and windows would be cut anew for every word.
    one = F.inline(F.array(F.struct(*figures, kept.alias("kept"), "lines_removed", "clean_text")))
    d = d.select(*kept_on, one)
    return d.select(F.col("_id").alias(id_col), *figures, "kept", "lines_removed", "clean_text", *[F.col(f"_carry_{k}").alias(k) for k in carry])


def op3_line_quality(spark, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    out = clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.drop("clean_text")


def _sql(rules: LineRules = LineRules()) -> str:
    ends = ", ".join("'" + e.replace("'", "''") + "'" for e in ENDINGS)
    gone = lambda c, chars: f"translate({c}, {chars}, '')"
    count = lambda c, chars: f"(length({c}) - length({gone(c, chars)}))"
    ws, tabs, symbols, seps = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)", "chr(32)||chr(9)", f"'{SYMBOLS}'", f"'{SEPARATORS}'"
    t = f"trim(x, {ws})"
    pieces = f"({count(t, tabs)} + 1)"
    stays = f"""({t} = '' OR ((right({t}, 1) IN ({ends}) OR {pieces} >= {rules.bare_words})
        AND {count(t, symbols)} * 100 <= length({t}) * {rules.symbol_percent}
        AND NOT ({count(t, seps)} >= {rules.min_separators} AND {count(t, seps)} * 4 >= {pieces})
        AND NOT (length({t}) <= {LONGEST_NAVIGATION} AND {pieces} <= 4 AND regexp_matches(lower({t}), '{_navigation()}'))
        AND NOT len(regexp_extract_all({t}, '{LINKS}')) * 100 > {pieces} * {rules.link_percent}
        AND NOT ({pieces} <= {rules.boilerplate_words} AND regexp_matches(lower({t}), '{'|'.join(BOILERPLATE)}'))))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, string_split(t, chr(10)) AS lines FROM d),
x AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
v AS (SELECT r, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM x WINDOW p AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM v WHERE w3 IS NOT NULL),
s AS (SELECT DISTINCT r, i + k AS i FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1),
n AS (SELECT r, count(*) AS n_repeat_words FROM s GROUP BY r),
b AS (SELECT w.r, doc_id, len(words)::BIGINT AS n_words, length({gone("t", ws)})::BIGINT AS word_chars, {count("t", symbols)}::BIGINT AS n_symbols,
  (len(list_filter(lines, lambda x: {t} <> '')) - len(list_distinct(list_filter(lines, lambda x: {t} <> ''))))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, list_filter(lines, lambda x: {stays}) AS clean
  FROM w LEFT JOIN n ON w.r = n.r),
j AS (SELECT *, n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat_percent} AS base_failed,
  coalesce(array_to_string(clean, chr(10)), '') AS c FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (word_chars - length({gone("c", ws)})) * 100 <= word_chars * {rules.max_lost_percent} AS kept,
  (n_lines - len(clean))::BIGINT AS lines_removed
FROM j"""


SQL = _sql()
