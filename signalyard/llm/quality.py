"""Quality rules: line-first cleaning.

Punctuation, navigation and boilerplate rules are evaluated on each line; lines that fail are removed, and a document
is rejected if that removes too much of its text. Document-level counts (words, symbols, repeated lines, repeated
five-word windows) come from the same pass. The lists of navigation and boilerplate are in English, German, French and
Spanish.

Null text: no words, so the document fails the base rules and is not kept; its clean text stays null. Empty text: as
null, with an empty clean text. Null id: its row is kept. Very long texts: one at a time, by lines. Ties do not occur;
repeated rows each get their own result; empty table: empty result; other columns are not read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

SYMBOLS = b"#*$%&|<>"
#: Lines that are a label to click on. Fixed values, by language.
NAVIGATION = (
    r"(?i)^(?:home|menu|login|log in|sign in|sign up|register|search|next|previous|prev|back|contact|contact us|about|about us"
    r"|sitemap|share|share this|tweet|print|read more|more|skip to (?:main )?content|top|back to top"
    r"|startseite|menü|anmelden|abmelden|registrieren|suche|suchen|weiter|zurück|kontakt|über uns|impressum|datenschutz|teilen|drucken|weiterlesen|mehr lesen|nach oben|zum inhalt"
    r"|accueil|connexion|se connecter|inscription|s.inscrire|rechercher|suivant|précédent|retour|nous contacter|à propos|plan du site|partager|imprimer|lire la suite|haut de page"
    r"|inicio|menú|iniciar sesión|registrarse|buscar|siguiente|anterior|volver|contacto|acerca de|sobre nosotros|mapa del sitio|compartir|leer más|arriba)[\s.!>»]*$"
)
#: What pages say about themselves. Fixed values, by language.
BOILERPLATE = (
    r"(?i)all rights reserved|\bcookies?\b.{0,40}\b(?:policy|accept|settings|use)\b|\bterms of (?:use|service)\b|\bprivacy policy\b"
    r"|enable javascript|javascript is (?:disabled|required)|lorem ipsum|click here|subscribe to our|\bcopyright (?:\(c\)|©|[0-9]{4})"
    r"|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|allgemeine geschäftsbedingungen|klicken sie hier|newsletter abonnieren"
    r"|tous droits réservés|politique de confidentialité|conditions d.utilisation|mentions légales|cliquez ici|abonnez-vous"
    r"|todos los derechos reservados|política de (?:privacidad|cookies)|términos (?:y condiciones|de uso)|aviso legal|haga clic aquí|suscríbase"
)
#: One of these stands, in lower case, in all that BOILERPLATE matches.
HINTS = (
    "rights reserved", "cookie", "terms of", "privacy policy", "javascript", "lorem ipsum", "click here", "subscribe to", "copyright", "rechte vorbehalten",
    "datenschutzerkl", "nutzungsbedingungen", "ftsbedingungen", "klicken sie", "newsletter abonnieren", "tous droits", "politique de", "utilisation", "mentions l",
    "cliquez ici", "abonnez-vous", "los derechos", "tica de privacidad", "rminos", "aviso legal", "haga clic", "suscr",
)
#: Letters that match others when case is ignored, though lower case does not make them so.
_FOLDED = ("\u0131", "\u0130", "\u017f", "\u212a")
_NAVIGATION, _BOILERPLATE = re.compile(NAVIGATION), re.compile(BOILERPLATE)


@dataclass(frozen=True)
class LineRules:
    """max_symbol_share: symbols among a line's characters. max_separators: of a navigation line with short items.
    max_lost: share of a document's word characters that lines may take with them."""

    max_symbol_share: float = 0.25
    min_separators: int = 4
    max_item_chars: int = 14
    max_lost: float = 0.5


def may_hold_boilerplate(text: str) -> bool:
    """False only if no line of the text can match BOILERPLATE."""
    low = text.lower()
    return any(map(low.__contains__, HINTS)) or not text.isascii() and any(map(text.__contains__, _FOLDED))


def line_fails(line: str, rules: LineRules, boilerplate: bool = True) -> str | None:
    """The rule that a line breaks: punctuation, navigation, boilerplate, or None. `boilerplate`: whether to look for it."""
    body = line.strip()
    if not body:
        return None
    symbols = sum(map(body.count, SYMBOLS.decode()))
    bars = body.count("|") + body.count("»") + body.count("›")
    if bars >= rules.min_separators and len(body) / (bars + 1) <= rules.max_item_chars:
        return "navigation"
    if symbols > rules.max_symbol_share * len(body) or not any(map(str.isalnum, body)):
        return "punctuation"
    if len(body) <= 24 and _NAVIGATION.match(body):
        return "navigation"
    if boilerplate and len(body) <= 400 and _BOILERPLATE.search(body):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == n:
        return 0
    count, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def judge(raw: bytes | None, rules: LineRules) -> tuple:
    """Counts, verdicts and clean text of one document."""
    text = (raw or b"").decode("utf-8", "replace")
    words = (raw or b"").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, "\t\n\x0b\x0c\r "))
    symbols = sum(map(text.count, SYMBOLS.decode()))
    seen, dup, lines, out, lost, may = set(), 0, text.split("\n"), [], 0, may_hold_boilerplate(text)
    for line in lines:
        if line.isascii() and line.split() or line.strip("\t\n\x0b\x0c\r "):
            dup += line in seen
            seen.add(line)
        if line_fails(line, rules, may):
            lost += len(line) - sum(map(line.count, "\t\x0b\x0c\r "))
        else:
            out.append(line)
    repeats = repeated_words(words)
    base_failed = n < 10 or 100 * repeats > 20 * n
    kept = not base_failed and lost <= rules.max_lost * word_chars
    clean = None if raw is None else raw.decode("utf-8", "replace") if len(out) == len(lines) else "\n".join(out)
    return n, word_chars, symbols, dup, repeats, base_failed, kept, clean


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per document: id, counts, base_failed, kept, and clean_text (the text without failing lines) if asked for."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {_COUNTS}" + ", clean_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(x, rules) for x in b.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: 7 + with_text]
            names = [id_col, *(x.split()[0] for x in _COUNTS.split(", ")), "clean_text"][: 8 + with_text]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, schema)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, with the columns of `docs`; text without the failing lines, n_chars counted anew."""
    prepare(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            found = [judge(None if x is None else x.encode(), rules) for x in b.column(at).to_pylist()]
            kept = pa.array([x[6] for x in found], pa.bool_())
            columns = [b.column(i) for i in range(b.num_columns)]
            columns[at] = pa.array([x[7] for x in found], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(kept)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
