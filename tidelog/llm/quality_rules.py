"""Quality rules: line-first cleaning.

Every line is held against punctuation, navigation, boilerplate and noise rules; lines
that fail go, and a document that loses too much of its text is rejected. Before that,
whole-text statistics (length, repeated word windows) reject the hopeless ones.

Lists of words are kept by language (English, French, German, Spanish); rules on line ends,
noise, capitals, separators and links need no language.

Plan. One scan, no shuffle: all rules are row-wise expressions. The repeated windows of
a text are found by hashing its 8-word windows; the sort that locates them runs only in
texts whose hashes are not all distinct.

Defined cases. A null text has no word, no line and is rejected. Repeated rows are judged
alike. Columns named like an added one are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, drop_columns, let, text_or_empty, window_hashes, ws_words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: A document keeps at least this share of the characters of its lines.
MIN_KEPT_SHARE = 0.6
END_MARKS = "[.!?:;…。！？][\"'”’»)\\]]*\\z"
#: What menus consist of, as a whole line, and phrases of boilerplate, in each language that the rules know.
#: Letters beyond ASCII stand in both cases, for not every engine folds them.
NAVIGATION_WORDS = {
    "en": "home|menu|next|previous|back|login|log in|sign in|sign up|search|share|contact|read more",
    "fr": "accueil|menu|suivant|pr[éÉ]c[éÉ]dent|retour|connexion|se connecter|s'inscrire|recherche|rechercher|partager|contact|nous contacter|lire la suite|en savoir plus|plan du site",
    "de": "startseite|men[üÜ]|weiter|zur[üÜ]ck|anmelden|einloggen|registrieren|suche|suchen|teilen|kontakt|impressum|mehr lesen|weiterlesen|mehr erfahren",
    "es": "inicio|men[úÚ]|siguiente|anterior|volver|iniciar sesi[óÓ]n|registrarse|buscar|compartir|contacto|leer m[áÁ]s|ver m[áÁ]s|mapa del sitio",
}
BOILERPLATE_PHRASES = {
    "any": "lorem ipsum|javascript",
    "en": "enable cookies|use of cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|subscribe to|sign up for|follow us|skip to (main )?content|powered by",
    "fr": "utilis(e|er|ons|ation) (de |des |de[s]? )?cookies|accepter les cookies|politique de confidentialit[éÉ]|conditions (g[éÉ]n[éÉ]rales )?d['’]utilisation|mentions l[éÉ]gales|tous droits r[éÉ]serv[éÉ]s|cliquez ici|abonnez-vous|inscrivez-vous [àÀ]|suivez-nous|aller au contenu|propuls[éÉ] par",
    "de": "verwende(t|n) cookies|cookies (akzeptieren|zulassen)|cookie-richtlinie|datenschutzerkl[äÄ]rung|nutzungsbedingungen|allgemeine gesch[äÄ]ftsbedingungen|alle rechte vorbehalten|klicken sie hier|hier klicken|abonnieren sie|melden sie sich an|folgen sie uns|zum inhalt springen|bereitgestellt von",
    "es": "(uso|utiliza|utilizamos|usamos) (de )?cookies|aceptar (las )?cookies|pol[íÍ]tica de (privacidad|cookies)|t[éÉ]rminos (de uso|y condiciones|del servicio)|aviso legal|todos los derechos reservados|haga clic aqu[íÍ]|haz clic aqu[íÍ]|suscr[íÍ]bete|suscr[íÍ]base|s[íÍ]guenos|s[íÍ]ganos|(saltar|ir) al contenido|con la tecnolog[íÍ]a de",
}
#: Structure that needs no words: entries between separators, and a line of links.
SEPARATED = "[^ ] ?[|»«›•>·→] [^\n]*[^ ] ?[|»«›•>·→] "
LINKS = "(https?://|www[.])[^ ]+ [^\n]*(https?://|www[.])[^ ]+ [^\n]*(https?://|www[.])"
WHOLE_LINE = f"(?i:^({'|'.join(NAVIGATION_WORDS.values())})[^a-z0-9]*\\z)"
NAVIGATION = f"{SEPARATED}|{LINKS}|{WHOLE_LINE}"
BOILERPLATE = f"(?i)({'|'.join(BOILERPLATE_PHRASES.values())})"
#: Every phrase of boilerplate holds one of these, which are looked for first: a plain search costs far less than the alternatives.
STEMS = (
    "ipsum", "javascript", "cookie", "privacy", "terms of", "rights reserved", "click here", "subscribe to", "sign up", "follow us", "skip to", "powered by", "politique de", "utilisation", "mentions l", "tous droits", "cliquez ici", "abonnez-vous",
    "inscrivez-vous", "suivez-nous", "aller au contenu", "propuls", "datenschutzerkl", "nutzungsbedingungen", "allgemeine gesch", "alle rechte", "klicken", "abonnieren sie", "melden sie sich", "folgen sie uns", "zum inhalt", "bereitgestellt von",
    "tica de", "rminos ", "aviso legal", "todos los derechos", "clic aqu", "suscr", "guenos", "ganos", "al contenido", "con la tecnolog",
)
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_kept_lines", "kept_share", "base_failed", "kept"]


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a ``window``-word window found twice or more in the text."""
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.slice(window_hashes(h, window), 1, F.size(h) - (window - 1)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.sort_array(F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull()))
        steps = lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(window), b - a))
        return let(let(placed, twice), lambda p: F.aggregate(steps(p), F.lit(0), lambda acc, x: acc + x))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def line_passes(line: Column) -> Column:
    """The line rules; ``line`` is a line with a word."""
    return let(F.btrim(line, F.lit(WS)), lambda s: let(F.size(F.split(s, "[\\x20\\x09-\\x0D]+", -1)), lambda n: _passes(s, n)))


def _passes(stripped: Column, n: Column) -> Column:
    noise = F.char_length(F.regexp_replace(stripped, "[^#*$%&|<>!{}=~^_\\\\]+", ""))
    capitals = F.char_length(F.regexp_replace(stripped, "[^\\p{Lu}]+", ""))
    small = F.char_length(F.regexp_replace(stripped, "[^\\p{Ll}]+", ""))
    ended = stripped.rlike(END_MARKS) | ((n >= 12) & stripped.rlike("[.!?] "))
    # each of these is the pattern behind a cheap condition that it implies
    separated = stripped.rlike("[|»«›•>·→]") & stripped.rlike(SEPARATED)
    links = (stripped.contains("http") | stripped.contains("www.")) & stripped.rlike(LINKS)
    phrase = let(F.lower(stripped), lambda low: reduce(Column.__or__, [low.contains(x) for x in STEMS])) & stripped.rlike(BOILERPLATE)
    return ended & (noise * 4 <= n) & ((n < 4) | (capitals <= small)) & ~separated & ~links & ~stripped.rlike(WHOLE_LINE) & ~phrase


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """``docs`` with the statistics in ``ADDED`` and ``cleaned_text`` (the lines that passed)."""
    docs = drop_columns(docs, [*ADDED, "cleaned_text"])
    text = text_or_empty(text_col)
    with_word = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    out = docs.withColumns({"__tl_words": ws_words(text), "__tl_lines": with_word})
    out = out.withColumns({"__tl_good": F.filter("__tl_lines", line_passes), "n_words": F.size("__tl_words").cast("bigint"), "n_lines": F.size("__tl_lines").cast("bigint")})
    out = out.withColumns({
        "word_chars": F.char_length(F.array_join("__tl_words", "")).cast("bigint"),
        "n_symbols": F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint"),
        "n_dup_lines": (F.size("__tl_lines") - F.size(F.array_distinct("__tl_lines"))).cast("bigint"),
        "n_repeat_words": n_repeat_words(F.col("__tl_words")).cast("bigint"),
        "n_kept_lines": F.size("__tl_good").cast("bigint"),
        "cleaned_text": F.array_join("__tl_good", "\n"),
        "__tl_all_chars": F.char_length(F.array_join("__tl_lines", "")),
    })
    out = out.withColumn("kept_share", F.when(F.col("__tl_all_chars") > 0, F.char_length(F.array_join("__tl_good", "")) / F.col("__tl_all_chars")).otherwise(F.lit(0.0)))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= min_kept_share))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED, "cleaned_text")
