"""The text operators against brute force on small tables with every awkward row."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import decontaminate as dc
from tidelog.llm import importance, langid, license_scan
from tidelog.llm.chat_format import chat_format, encoder, loss_mask, read_back, unescape
from tidelog.llm.jaccard_join import components, connected, jaccard_join, membership
from tidelog.llm.line_dedup import line_dedup
from tidelog.llm.mix import mix
from tidelog.llm.quality_rules import quality_rules
from tidelog.llm.token_count import counter as cached_counter
from tidelog.llm.token_count import default_path, token_counts

DOCS = "doc_id bigint, text string, source string, extra int"
PROSE = "The river rose in the night and the old bridge was gone by morning light. Nobody had seen it fall, and nobody wanted to say so."
ROWS = [
    (1, PROSE, "a", 1), (2, PROSE, "a", 2), (3, PROSE.replace("old", "new"), "b", 3), (4, None, None, 4), (5, "", "b", 5), (6, " \n\t ", "a", 6), (7, "x " * 4000 + "end.", "b", 7),
    (8, "a shared line of text\nown words here\nA SHARED LINE OF TEXT \n", "c", 8), (9, "\ta shared line of text\nother words", None, 9), (9, "\ta shared line of text\nother words", None, 9), (None, "a shared line of text", "a", 10), (11, "Ünï cödé 日本語 \U0001f600 ok", "a", 11),
]
WORD = re.compile("[^\x20\x09-\x0d]+")
M64 = (1 << 64) - 1
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", lang string")


# line dedup


def dedup_by_hand(rows, min_docs=2):
    keys = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    held = defaultdict(set)
    order = lambda i: (i is None, i or 0)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[keys(line)].add(order(i))
    out = []
    for i, text, *_ in rows:
        kept = [x for x in (text or "").split("\n") if not (len(keys(x)) >= 10 and len(held[keys(x)]) >= min_docs and order(i) != min(held[keys(x)]))]
        out.append((i, "\n".join(kept), len((text or "").split("\n")), len((text or "").split("\n")) - len(kept)))
    return out


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(docs, min_docs):
    got = [tuple(r) for r in line_dedup(docs, min_docs=min_docs).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=repr) == sorted(dedup_by_hand(ROWS, min_docs), key=repr)


def test_line_dedup_replaces_clashing_columns(docs, empty):
    clash = ["_doc", "_row", "_drop", "key", "pos"]
    out = line_dedup(docs.withColumns({"N_LINES": F.lit("x")} | {c: F.lit(c) for c in clash}))
    assert out.columns == ["doc_id", "text", "source", "extra", *clash, "n_lines", "n_dropped"]
    assert {tuple(r[c] for c in clash) for r in out.collect()} == {tuple(clash)}
    assert line_dedup(empty).count() == 0


# mix


def test_mix(docs, empty):
    rows = mix(docs.withColumns({"taken": F.lit("clash"), "n_docs": F.lit("own"), "target": F.lit("x")})).collect()
    assert {r["n_docs"] for r in rows} == {"own"}
    sizes = {r["extra"]: len(WORD.findall(r["text"] or "")) for r in rows}
    assert all(r["size"] == sizes[r["extra"]] for r in rows) and len(rows) == len(ROWS)
    total = sum(r["size"] for r in rows)
    by = {s: [r for r in rows if r["source"] == s] for s in ("a", "b", "c", None)}
    own = {s: sum(r["size"] for r in x) for s, x in by.items()}
    want, weight = {}, {"a": 5, "b": 2, "c": 1, None: 5}
    left, room = total, dict(weight)
    while True:
        shares = {s: left * w / sum(room.values()) for s, w in room.items()}
        over = [s for s in shares if shares[s] > 3 * own[s] + 1e-9]
        if not over:
            want |= shares
            break
        for s in over:
            want[s] = 3 * own[s]
            left -= want[s]
            del room[s]
    for s, x in by.items():
        assert x[0]["target"] == pytest.approx(want[s]) and x[0]["source_size"] == own[s]
        assert abs(sum(r["taken"] for r in x) - want[s]) <= 1 + sum(1 for r in x if r["extra"] == 9)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(repr, mix(docs).collect())) == sorted(map(repr, mix(docs.repartition(5)).collect()))
    assert mix(empty).count() == 0


# decontamination

ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then runs away home again"), (2, "Short Item"), (3, None), (4, "..."), (5, PROSE)]


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def scan_by_hand(rows, items):
    grams = defaultdict(set)
    for i, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            grams[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, text, *_ in rows:
        w, hit, found = words_of(text), set(), set()
        for g, owners in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= owners
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [500_000, 3])
def test_decontamination(spark, docs, empty, block):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    more = [(20, "so THE quick,brown fox jumps over the lazy dog and then runs away! a short item.", "a", 0), (21, "short item short item", "a", 0), (22, "word " * 500 + "short item", "a", 0)]
    all_docs = docs.unionByName(spark.createDataFrame(more, DOCS))
    got = [tuple(r) for r in dc.scan(all_docs, items, max_broadcast=block).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()]
    assert sorted(got, key=repr) == sorted(scan_by_hand(ROWS + more, ITEMS), key=repr)
    assert dc.scan(empty, items).count() == 0
    assert {r["contaminated"] for r in dc.scan(docs, items.limit(0)).collect()} == {False}


def test_decontamination_removes(spark):
    items = spark.createDataFrame([(1, "bad phrase here")], "item_id bigint, text string")
    rows = spark.createDataFrame([(1, "Good words. Bad phrase, here! More words.", 1), (2, "Bad phrase here", 2), (3, "fine", 3), (None, "bad phrase here", 4)], "doc_id bigint, text string, _row int")
    assert [r["doc_id"] for r in dc.decontaminate(rows, items).collect()] == [3]
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(rows, items, mode="span").collect()}
    assert cut == {1: "Good words. More words.", 2: "", 3: "fine", None: ""}
    with pytest.raises(ValueError):
        dc.decontaminate(rows, items, mode="all")


# quality rules


def test_quality_rules(spark, docs, empty):
    rows = {r["extra"]: r for r in quality_rules(docs).collect()}
    for _, text, _, n in ROWS:
        w = WORD.findall(text or "")
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = rows[n]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert rows[1]["kept"] and not rows[7]["kept"]
    junk = [(1, "Home | News | Sport | Weather | Login\n" * 3 + PROSE, "a", 1), (2, " ".join(f"{w}***" for w in PROSE.split()), "a", 2), (3, PROSE.upper(), "a", 3), (4, PROSE + "\nAll rights reserved.", "a", 4)]
    judged = {r["extra"]: r for r in quality_rules(spark.createDataFrame(junk, DOCS)).collect()}
    assert [judged[i]["kept"] for i in (1, 2, 3, 4)] == [False, False, False, True] and judged[4]["cleaned_text"] == PROSE
    assert quality_rules(empty).count() == 0


LINES = {
    "en": (["Home", "Read more »", "All rights reserved."], "The house stood at the end of the road, and nobody had lived in it for years."),
    "fr": (["Accueil", "Lire la suite…", "Tous droits réservés.", "TOUS DROITS RÉSERVÉS.", "Nous utilisons des cookies pour mesurer notre audience.", "Suivez-nous!"], "La maison se trouvait au bout de la route, et personne n'y avait habité depuis des années."),
    "de": (["Startseite", "Zurück.", "Alle Rechte vorbehalten.", "Diese Seite verwendet Cookies.", "Bitte lesen Sie die Datenschutzerklärung."], "Das Haus stand am Ende der Straße, und seit Jahren hatte niemand mehr darin gewohnt."),
    "es": (["Inicio", "Leer más...", "Todos los derechos reservados.", "Síguenos!", "Utilizamos cookies propias y de terceros."], "La casa estaba al final del camino, y nadie había vivido en ella desde hacía años."),
    "none": (["Новости · Спорт · Погода · Ещё.", "http://a.example/x www.b.example https://c.example/y."], "Дом стоял в конце дороги, и никто не жил в нём уже много лет."),
}


@pytest.mark.parametrize("lang", sorted(LINES))
def test_line_rules_by_language(spark, lang):
    junk, good = LINES[lang]
    text = "\n".join([good, *junk, good.replace(",", " (sic),"), good[::-1] + "."])
    r = quality_rules(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert r["cleaned_text"].split("\n") == [good, good.replace(",", " (sic),"), good[::-1] + "."] and r["n_lines"] == len(junk) + 3


PHRASES = """Lorem ipsum dolor.|JavaScript is off.|Enable cookies now.|Our use of cookies.|Cookie Policy.|The privacy policy.|Terms of use.|Terms of Service.|All rights reserved.|Click here.|Subscribe to it.|Sign up for it.|Follow us.|Skip to content.|Skip to main content.|Powered by it.|
Utiliser des cookies.|Accepter les cookies.|Politique de confidentialité.|Conditions d'utilisation.|Conditions générales d’utilisation.|Mentions légales.|Tous droits réservés.|Cliquez ici.|Abonnez-vous.|Inscrivez-vous à la lettre.|Suivez-nous.|Aller au contenu.|Propulsé par eux.|
Wir verwenden Cookies.|Sie verwendet Cookies.|Cookies akzeptieren.|Cookies zulassen.|Cookie-Richtlinie.|DatenschutzerklÄrung.|Nutzungsbedingungen.|Allgemeine Geschäftsbedingungen.|Alle Rechte vorbehalten.|Klicken Sie hier.|Bitte hier klicken.|Abonnieren Sie uns.|Melden Sie sich an.|Folgen Sie uns.|Zum Inhalt springen.|Bereitgestellt von uns.|
El uso de cookies.|Utilizamos cookies.|Usamos cookies.|Aceptar las cookies.|Política de privacidad.|POLÍTICA DE COOKIES.|Términos de uso.|Términos y condiciones.|Términos del servicio.|Aviso legal.|Todos los derechos reservados.|Haga clic aquí.|Haz clic aquí.|Suscríbete.|Suscríbase.|Síguenos.|Síganos.|Saltar al contenido.|Ir al contenido.|Con la tecnología de ellos."""


def test_every_phrase_passes_the_search_that_comes_first(spark):
    from tidelog.llm.quality_rules import BOILERPLATE, STEMS

    phrases = [p.strip() for p in PHRASES.split("|")]
    assert all(any(x in p.lower() for x in STEMS) for p in phrases) and len(phrases) > 60
    rows = spark.createDataFrame([(i, f"{p}\n{PROSE}\nUnd {p.lower()}") for i, p in enumerate(phrases)], "doc_id bigint, text string")
    got = quality_rules(rows).select("text", "cleaned_text", F.col("text").rlike(BOILERPLATE).alias("hit")).collect()
    assert [r["text"] for r in got if not r["hit"] or r["cleaned_text"] != PROSE] == []


# language ID

EN, DE = "the quick dog ran over the hill and then went home with the others", "der schnelle Hund lief über den Hügel und ging dann mit den anderen nach Hause"


def test_language_id(spark, empty):
    rows = [(i, f"{EN} {i}", "en") for i in range(40)] + [(i, f"{DE} {i}", "de") for i in range(40, 80)] + [(i, "собака бежала домой через холм", "ru") for i in range(80, 100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["de", "en", "ru"]
    tests = [(1, f"{EN}. {DE}. {EN}"), (2, None), (3, "123 !?"), (4, "собака"), (5, DE * 3000), (6, ""), (7, "İ the dog went over the hill")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(tests, "doc_id bigint, text string").withColumn("score", F.lit("x")), model).collect()}
    assert got[1]["lang_pred"] == "en" and got[1]["span_langs"] == ["en", "de", "en"] and 0.5 < got[1]["score"] < 0.8
    assert [got[i]["lang_pred"] for i in (2, 3, 6)] == ["und"] * 3 and got[2]["score"] == 0
    assert (got[4]["lang_pred"], got[5]["lang_pred"], got[7]["lang_pred"]) == ("ru", "de", "en")
    assert langid.identify(empty, langid.train(empty)).count() == 0
    held = docs.filter(langid.is_held_out("doc_id")).collect()
    assert sorted(r["doc_id"] for r in held) == [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2]


def words_by_hand(text):
    """(letters, script, trigram buckets) of each run of letters and marks."""
    import unicodedata

    low = "".join(x if len(x := c.lower()) == 1 else c for c in text or "")
    inside = lambda c: unicodedata.category(c)[0] in "LM"
    out = []
    for m in re.finditer("[^\x00]+", "".join(c if inside(c) else "\x00" for c in low)):
        w = [32, *map(ord, m[0]), 32]
        grams = [((a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ c * 0x165667B19E3779F9) & M64) * 0xFF51AFD7ED558CCD % (1 << 64) >> (64 - langid.BITS) for a, b, c in zip(w, w[1:], w[2:])]
        script = next(s for a, s in reversed(langid.SCRIPTS) if a <= w[1])
        out.append((sum(unicodedata.category(c)[0] == "L" for c in m[0]), script, grams))
    return out


def test_language_scores_against_brute_force(spark):
    import math

    rows = [(i, f"{EN} {'quick ' * (i % 3)}{i}", "en") for i in range(30)] + [(i, f"{DE} {'Hügel ' * (i % 4)}", "de") for i in range(30, 60)] + [(i, "собака бежала домой через холм и лес", "ru") for i in range(60, 80)] + [(None, EN, "en"), (81, None, "en"), (82, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts = [f"{EN}. {DE}", f"собака {EN} домой", f"{DE} холм", "dog", "Hügel über", "ДОМОЙ the", "e\u0301te\u0301 the hill", "漢字 the", "1 2", None, f"{EN} {DE} собака бежала " * 3]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), langid.train(docs)).orderBy("doc_id").collect()
    learned = [r for r in rows if r[1] is not None and r[2] and not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2)]
    langs = ["de", "en", "ru"]
    grams, scripts = {k: Counter() for k in langs}, {k: Counter() for k in langs}
    for _, text, lang in learned:
        for letters, script, g in words_by_hand(text):
            grams[lang].update(g)
            scripts[lang][script] += letters
    n = 1 << langid.BITS
    log = {k: lambda g, k=k: math.log((grams[k][g] + langid.SMOOTHING) / (sum(grams[k].values()) + n * langid.SMOOTHING)) for k in langs}
    allowed = lambda k, s: scripts[k][s] >= 0.001 * max(sum(scripts[k].values()), 1) or not any(scripts[x][s] >= 0.001 * max(sum(scripts[x].values()), 1) for x in langs)
    for r, text in zip(got, texts, strict=True):
        words = words_by_hand(text)
        if not sum(w[0] for w in words):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        best = [(0.0, ())]
        paths = {k: (0.0, ()) for k in langs}
        for at, (_, script, g) in enumerate(words):
            own = {k: sum(map(log[k], g)) - (0 if allowed(k, script) else 1e6) for k in langs}
            paths = {k: max((v + own[k] - (langid.SWITCH if at and p[-1] != k else 0), (*p, k)) for v, p in paths.values()) for k in langs}
        best = max(paths.values())[1]
        share = Counter()
        for k, w in zip(best, words, strict=True):
            share[k] += w[0]
        lang, most = max(share.items(), key=lambda x: x[1])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(most / sum(share.values()))
        assert r["span_langs"] == [k for i, k in enumerate(best) if i + 1 == len(best) or best[i + 1] != k]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        langid.train(spark.createDataFrame([(i, EN, lang) for i, lang in enumerate(["a", "b", "c", "d", "e", "f"])], "doc_id bigint, text string, lang string"))


@given(st.lists(st.lists(st.lists(st.floats(-9, 0), min_size=3, max_size=3), max_size=7), min_size=1, max_size=4))
@settings(deadline=None)
def test_viterbi_is_the_best_path(seqs):
    import itertools

    scores = [np.array(s, np.float32).reshape(-1, 3) for s in seqs]
    for s, path in zip(scores, langid.viterbi(scores, 2.0), strict=True):
        value = lambda p: sum(float(s[i, k]) for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert len(path) == len(s)
        if len(s):
            assert value(path.tolist()) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=len(s))), abs=1e-4)


# n-gram Jaccard join


def join_by_hand(rows):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").translate(UPPER))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    ids = [2**63 - 1 if r[0] is None else r[0] for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and (100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) or ids[i] == ids[j] and sets[i] == sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min(ids[i] for i in range(len(rows)) if group[i] == g) for g in group}
    return [(r[0], len(s), None if least[g] == 2**63 - 1 else least[g]) for r, s, g in zip(rows, sets, group, strict=True)]


def near_copies(seed):
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 8, 60, 150]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.4:
                base = copy
            rows.append((i, " ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy), "s", i))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_jaccard_join(spark, seed, monkeypatch):
    import tidelog.llm.jaccard_join as jj

    if seed > 1:  # many ranges, chunks and groups, as at scale
        monkeypatch.setattr(jj, "RANGE", 200)
        monkeypatch.setattr(jj, "CHUNK", 300)
        monkeypatch.setattr(jj, "SLICE_GROUP", 20)
        monkeypatch.setattr(jj, "CLUSTER", 250)
        monkeypatch.setattr(jj, "HUB", 3)
    if seed > 2:  # shingles of two chunks are heavy
        monkeypatch.setattr(jj, "HEAVY", 2)
        monkeypatch.setattr(jj, "HEAVY_MOST", 500)
        monkeypatch.setattr(jj, "BROADCAST_BYTES", 0)
    rows = near_copies(seed) + [(r[0] + 1000 if r[0] else r[0], *r[1:]) for r in ROWS]
    got = [tuple(r) for r in membership(spark.createDataFrame(rows, DOCS).repartition(5)).select(F.when(F.col("__tl_id") < 2**63 - 1, F.col("__tl_id")), "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(join_by_hand(rows), key=repr)


def test_jaccard_join_keeps_columns(docs, empty):
    out = jaccard_join(docs.withColumn("N_shingles", F.lit("x")))
    assert out.columns == ["doc_id", "text", "source", "extra", "n_shingles", "component_id"] and out.count() == len(ROWS)
    assert {r["extra"]: r["component_id"] for r in out.collect()}[2] == 1
    assert membership(empty).count() == 0


@given(st.lists(st.frozensets(st.integers(0, 40), min_size=1), min_size=1, max_size=9, unique=True))
@settings(max_examples=300, deadline=None)
def test_trie_components(sets):
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    assert components(list(range(len(sets))), [np.array(sorted(s), np.uint64) for s in sets]) == want


@pytest.mark.parametrize("hub", [10_000, 2])
def test_connected_components(spark, monkeypatch, hub):
    import tidelog.llm.jaccard_join as jj

    monkeypatch.setattr(jj, "HUB", hub)
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60), (60, 50), (-3, 70)] + [(200 + i, 999) for i in range(40)] + [(100, 300 + i) for i in range(20)] + [(319, 400)]
    got = {r["node"]: r["cluster"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 50: 40, 60: 40, -3: -3, 70: -3, 999: 200, 100: 100, 400: 100} | {200 + i: 200 for i in range(40)} | {300 + i: 100 for i in range(20)}


def test_a_family_of_near_copies_costs_one_comparison_each(monkeypatch):
    """Posting lists are passed over by component: 4,000 near copies are joined in linear time."""
    import time

    import pandas as pd

    import tidelog.llm.jaccard_join as jj

    def seconds(n):
        rng = np.random.default_rng(5)
        base = rng.integers(0, 2**60, 30, dtype=np.uint64)
        rows = []
        for i in range(n):
            own = base.copy()
            own[rng.integers(30)] = rng.integers(0, 2**60)
            rows.append((0, 0, i, np.sort(own).tobytes()))
        began = time.time()
        found = jj._slice_edges(85)((0, 0), pd.DataFrame(rows, columns=["slice", "part", "node", "tokens"]))
        assert len(found) == n - 1
        return time.time() - began

    seconds(100)
    assert seconds(8_000) < 10 * max(seconds(2_000), 0.05)


# token counts

TEXTS = st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["the", " ", "  ", "\n", "don't", "'s", "<|endoftext|>", "été", "12", "…", "€", " ", "\x1c", "日本", "!!", "thnd", "́"]), max_size=20).map("".join))


@given(TEXTS)
@settings(max_examples=500, deadline=None)
def test_token_counts_are_the_librarys(text):
    counter = cached_counter(default_path())
    assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_chat_encoding_is_the_librarys(text):
    e = encoder(default_path())
    text = f"<|im_start|>user<|im_sep|>{text}<|im_end|>\n"
    whole = e.tokenizer.encode(text, add_special_tokens=False)
    ids, starts, ends = e.encode(text)
    assert ids.tolist() == whole.ids and list(zip(starts.tolist(), ends.tolist(), strict=True)) == whole.offsets


WORLD = [
    "Съешь же ещё этих мягких французских булок, да выпей чаю.", "我能吞下玻璃而不伤身体。 下一句\u3000也是。", "אני יכול לאכול זכוכית וזה לא מזיק לי", "أنا قادر على أكل الزجاج و هذا لا يؤلمني", "मैं काँच खा सकता हूँ", "ยีนส์ กางเกง", "👩‍👩‍👧 ok 🇩🇪!! don't 𝒳\u200b \u2028x",
    "Ξεσκεπάζω τὴν ψυχοφθόρα  \n\t βδελυγμία \u1680 1\u0660\u0661 ٣ ²", "mixed naïve слово's日本 'll  <|endoftext|> конец ", "\u2003a \u205f \x1c\x1d б", "ı İ ſ ẞ ʼn ǆ 'ſ 's'ſ", "".join(map(chr, range(0x250, 0x600))),
]


@pytest.mark.parametrize("text", WORLD)
def test_other_scripts_are_counted_by_segments(text):
    counter, e = cached_counter(default_path()), encoder(default_path())
    for t in (text, f" {text}\n{text} ", text[::-1], "\n".join(text.split(" "))):
        assert counter.count(t) == counter.merged(t)
        whole = e.tokenizer.encode(t, add_special_tokens=False)
        ids, starts, ends = e.encode(t)
        assert ids.tolist() == whole.ids and list(zip(starts.tolist(), ends.tolist(), strict=True)) == whole.offsets


@given(st.lists(st.sampled_from(["слово", "日本", "\u3000", " ", "\n", "x", "'s", "é", "😀", "\u200b", "\u2028", "\x85", "\u0301", "١", "½", "!", "\t", "\x1f", "\ufeff"]), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_segments_are_independent(text):
    counter = cached_counter(default_path())
    assert counter.count(text) == counter.merged(text)


def test_the_shortcut_is_used_for_other_scripts():
    from tidelog.llm.token_count import pretokens

    assert pretokens("да и нет, 日本 ok!") == ["да", " и", " нет,", " 日本", " ok", "!"]
    assert len(pretokens(WORLD[0])) == 10


def test_the_encoder_forgets(monkeypatch):
    import tidelog.llm.chat_format as cf

    monkeypatch.setattr(cf, "REMEMBERED", 3)
    e = cf.Encoder(default_path())
    for text in ("one two three four five", "six seven eight", "one two", "", "nine ten eleven twelve thirteen"):
        assert e.encode(text)[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_every_safe_character_is_split_alike():
    counter = cached_counter(default_path())
    for c in map(chr, (*range(0x250), *range(0x2010, 0x2028), 0x20AC)):
        for text in (f"ab{c}cd", f" {c} {c}{c}x", f"1{c}2 {c}"):
            assert counter.count(text) == counter.merged(text), repr(text)


def test_token_count_rows(docs, empty):
    rows = {r["extra"]: r for r in token_counts(docs).collect()}
    assert (rows[4]["n_tokens"], rows[5]["n_bytes"], rows[7]["over_limit"]) == (0, 0, True)
    assert rows[11]["n_bytes"] == len(ROWS[-1][1].encode()) and token_counts(empty).count() == 0


# chat formatting


def test_chat_format(spark):
    rows = [
        (1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (2, 1, "assistant", " lead\n\n"), (2, 0, None, None), (2, 2, "assistant", ""), (2, 3, "assistant", "é日😀<\\|x<<|"),
        (2, 3, "assistant", "é日😀<\\|x<<|"), (3, None, "<|im_sep|>", "a"), (None, 0, "assistant", "b"), (4, 0, "assistant", "long " * 20000),
    ]
    got = {r["conv_id"]: r for r in read_back(chat_format(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t if t is not None else -1, role or "", text or ""))
    for c, x in turns.items():
        x.sort()
        loss = "".join(t for _, r, t in x if r == "assistant")
        assert got[c]["n_turns"] == len(x)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in x).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    none = chat_format(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert none.count() == 0


@given(st.text(alphabet="<|\\a", max_size=30))
def test_escape_is_reversible(text):
    escaped = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    assert "<|" not in escaped and unescape(escaped) == text


def test_loss_mask():
    starts, ends = np.array([0, 2, 2, 5, 9]), np.array([2, 3, 5, 9, 12])
    assert loss_mask(starts, ends, [(2, 5), (5, 5), (9, 12)]).tolist() == [0, 1, 1, 0, 1]
    assert loss_mask(starts, ends, []).tolist() == [0] * 5


# licence scan


def test_license_scan(spark, empty):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "licensed under CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(i, f"{PROSE}\n\n{line}\n{EN}") for i, line in enumerate(lines)] + [(9, f"{PROSE}\nthe license of the driver was lost"), (10, None), (11, "")] + [(i, f"{DE}\n{EN} {i}") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("licenses", F.lit("clash"))
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs, license_scan.train(docs)).collect()}
    assert [got[i]["licenses"] for i in range(4)] == [["Apache-2.0"], ["MIT"], ["CC-BY-NC"], ["GPL"]]
    assert all(got[i]["license_at"] == [2] and got[i]["n_paragraphs"] == 3 for i in range(4))
    assert all(got[i]["licenses"] == [] for i in got if i > 3) and got[10]["n_paragraphs"] == 0
    assert license_scan.license_scan(empty, license_scan.train(empty)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_license_scan_finds_wrapped_notices(spark):
    wrapped = [MIT, f"{PROSE}\n{MIT}\n{EN}", f"{EN}\n\n{MIT.replace(chr(10), chr(13) + chr(10))}\n\n{EN}", APACHE, f"{PROSE}\n{GPL}", MIT.replace(" ", "\n")]
    titles = ["MIT License", "The MIT License (MIT)", f"{PROSE}\n\nMIT License\n\nCopyright (c) 2020", "GNU GENERAL PUBLIC LICENSE"]
    clean = [MIT[: MIT.index("(the")].split("\n")[0], "\n".join([EN, *(f"{EN}\n{w}" for w in MIT.split("\n"))]), f"the MIT licence was lost\n{EN}", "permission is hereby granted\nto leave the room"]
    rows = list(enumerate(wrapped + titles + clean)) + [(i, f"{DE}\n{EN} {i}") for i in range(20, 60)] + [(60, f"{MIT}\n\n{EN}"), (61, MIT.split("\n", 1)[1]), (62, "\n".join(MIT.split("\n")[:1])), (63, "\n".join(MIT.split("\n")[1:]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs, license_scan.train(docs)).collect()}
    assert [got[i]["licenses"] for i in range(10)] == [["MIT"]] * 3 + [["Apache-2.0"], ["GPL"], ["MIT"]] + [["MIT"]] * 3 + [["GPL"]]
    # the template ends with "copies of the Software", in the fifth line
    assert [got[i]["license_at"] for i in (0, 1, 2)] == [[0, 1, 2, 3, 4], [1, 2, 3, 4, 5], [2, 3, 4, 5, 6]] and got[8]["license_at"] == [2]
    assert all(got[i]["licenses"] == [] for i in [*range(10, 14), *range(20, 60), 62])
    assert got[60]["licenses"] == got[61]["licenses"] == got[63]["licenses"] == ["MIT"]


def test_license_classifier_on_unseen_paragraphs(spark, sf_dir):
    """Variants that training did not see, lines of documents that it did not see, and wordings whose template was hidden."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    model = license_scan.train(docs)
    rng = np.random.default_rng(99)
    lines = [x for r in spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("text").limit(300).collect() for x in (r["text"] or "").split("\n") if len(x) > 2 and "icense" not in x]
    clean = [(x, "unknown") for x in lines]
    seen = [(v, f) for f, texts in license_scan.TEMPLATES.items() for t in texts for v in license_scan._variants(t, rng, 20)[1:]]
    got = license_scan.report(model, seen + clean)
    assert got["recall"] > 0.97 and got["precision"] > 0.97 and got["calibration_error"] < 0.05, got
    print("unseen variants", got)
    # a wording of which no template is known is left to the unknown class rather than given to a wrong family: templates confirm what is found, so it could not be found
    hidden = {f: texts[:-1] for f, texts in license_scan.TEMPLATES.items() if len(texts) > 1}
    unknown = [(texts[-1], f) for f, texts in license_scan.TEMPLATES.items() if f in hidden]
    got = license_scan.report(license_scan.train(docs, templates=hidden), unknown + [(x, "unknown") for x in lines])
    print("hidden wordings", got)
    assert got["calibration_error"] < 0.1, got


def test_license_scan_against_one_line_at_a_time(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    model = license_scan.train(docs)
    rng, prose = np.random.default_rng(3), sorted({x for r in docs.collect() for x in (r["text"] or "").split("\n")[:3]})
    apart = f"{PROSE} {PROSE}"  # notices so far apart are not taken for one that is wrapped
    notices = [v for f in license_scan.TEMPLATES.values() for t in f for v in license_scan._variants(t, rng, 2)] + [t for f in license_scan.TITLES.values() for t in f]
    texts = ["\n".join(x for i in range(int(rng.integers(0, 6))) for x in (prose[rng.integers(len(prose))], apart, notices[rng.integers(len(notices))] if rng.random() < 0.4 else "", apart)) for _ in range(60)]
    templates = {f: [license_scan._shingles(t) for t in license_scan.TEMPLATES[f]] for f in model.families[:-1]}
    got = license_scan._scan(model, templates, [t.encode() for t in texts])
    for text, (n, licenses, at, score) in zip(texts, got, strict=True):
        found = {}
        for i, line in enumerate(text.split("\n")):
            p = license_scan.probabilities(model, line.encode())[0][0]
            family = model.families[p.argmax()]
            if family != "unknown" and p.max() >= license_scan.MIN_PROBABILITY and license_scan._shingles(line) and license_scan._confirmed(line, templates[family]):
                found[i, family] = p.max()
            title = license_scan._title(line)
            if title:
                found.setdefault((i, title), p[model.families.index(title)])
        assert n == sum(bool(re.search("[0-9A-Za-z\x80-\U0010ffff]", x)) for x in text.split("\n"))
        assert (licenses, at) == (sorted({f for _, f in found}), sorted({i for i, _ in found})) and score == pytest.approx(max(found.values(), default=0), abs=1e-5)


# importance resampling


def test_importance_resampling(spark, empty):
    good, bad = [f"{EN} number {i}" for i in range(60)], [" ".join(f"{w}###" for w in EN.split()) + f" {i}" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 80, 2)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in importance.importance_resample(docs, labels).collect()}
    assert not any(got[i]["kept"] for i in range(60, 80)) and sum(r["kept"] for r in got.values()) == round(82 * 0.75)
    assert got[100]["log_ratio"] == got[101]["log_ratio"] == 0
    again = {r["doc_id"]: r["kept"] for r in importance.importance_resample(docs.repartition(7), labels).collect()}
    assert again == {i: r["kept"] for i, r in got.items()}
    assert all(r["kept"] for r in importance.importance_resample(docs, labels.limit(0)).collect())
    assert importance.importance_resample(empty, labels).count() == 0


def mixed(h):
    """The finalizer of ``hashing.mix``, on integers."""
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> 33
        h = h * c & M64
    return h ^ (h >> 33)


def buckets_by_hand(text):
    """Hashed tokens and pairs of one text: runs of letters, digits and longer characters, or of other visible ASCII."""
    values = [mixed(i * 0x2545F4914F6CDD1D & M64) for i in range(1, 257)]
    hashed = []
    for token in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode()):
        h, power = 0, 1
        for byte in token:
            h = (h + values[byte] * power) & M64
            power = power * 0x9E3779B97F4A7C15 & M64
        hashed.append(mixed(h))
    pairs = [1 << 63 if a == b else mixed((a * 0xD6E8FEB86659FD93 + b) & M64) for a, b in zip(hashed, hashed[1:])]
    return [h >> (64 - importance.BITS) for h in hashed + pairs]


def test_importance_against_brute_force(spark):
    import math

    texts = [f"{EN} {i % 5} naïve {i % 3}, " * (1 + i % 4) for i in range(40)] + ["!!! ### $$$ buy now!!! " * (1 + i % 3) for i in range(20)] + [None, "", "a a a a", EN]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, "other text of one id"), (5, texts[5])]
    labels = [(i, int(i < 40), int(i % 10 == 4)) for i in range(0, 60, 2)]
    got = importance.importance_resample(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("x")).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    good = {i for i, q, t in labels if q == 1 and t == 0}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets_by_hand(t))
        if i in good:
            target.update(buckets_by_hand(t))
    n = 1 << importance.BITS
    ratio = lambda b: math.log((target[b] + 1) / (sum(target.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n))
    want = {(i, t): round(sum(map(ratio, buckets_by_hand(t))), 6) for i, t in rows}
    assert {(r["doc_id"], r["text"]) for r in got} == set(want) and len(got) == len(rows)
    assert all(abs(r["log_ratio"] - want[r["doc_id"], r["text"]]) < 2e-6 for r in got)
    by = {(r["doc_id"], r["text"] or ""): (r["gumbel_key"], r["kept"]) for r in got}  # a null text is an empty one
    k = round(len(by) * sum(q for _, q, _ in labels) / len(labels))
    best = sorted(by.values(), reverse=True)
    assert [kept for _, kept in best] == [True] * k + [False] * (len(best) - k)
    noise = [r["gumbel_key"] - r["log_ratio"] for r in got]
    assert len({round(x, 9) for x in noise}) == len(by) and -3 < sum(noise) / len(noise) - 0.5772 < 3


def test_importance_pairs_stay_inside_a_document(spark):
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(60)] + [(60, "w1"), (61, "w1"), (62, None), (63, "w1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(0, 60, 2)], "doc_id bigint, quality int, toxic int")
    together, alone = ({r["doc_id"]: r["log_ratio"] for r in importance.importance_resample(docs.repartition(n, "doc_id"), labels).collect()} for n in (1, 64))
    assert together == alone and together[60] == together[61] == together[63]
    texts = [t or "" for _, t in rows]
    ((_, begin, data),) = importance._pieces(texts)
    each = [importance.features(t.encode(), np.array([0, len(t) + 1]))[0].tolist() for t in texts]
    bucket, at = importance.features(data, begin)
    of = np.searchsorted(begin, at, side="right") - 1
    assert [bucket[of == i].tolist() for i in range(len(texts))] == each
    assert importance.ngram_counts(docs.repartition(1), [60], "doc_id", "text").sum(axis=1).tolist() == [sum(map(len, each)), 1]


@given(st.lists(st.integers(-3, 3), min_size=1, max_size=30), st.data())
@settings(max_examples=15, deadline=None)
def test_kth_largest(spark, values, data):
    k = data.draw(st.integers(1, len(values)))
    keys = spark.createDataFrame([(float(v) / 7, i // 2, -i) for i, v in enumerate(values)], "gumbel_key double, __tl_i bigint, __tl_row bigint")
    ranked = sorted(((float(v) / 7, i // 2, -i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1], x[2]))
    assert importance.kth_largest(keys, k) == ranked[k - 1]
