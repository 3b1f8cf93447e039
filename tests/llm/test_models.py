"""Language-model scores, toxicity and chat formatting."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbmark.llm import bpe, chat, langid, ppm, toxicity
from ebbmark.llm.common import id_remainder
from tests.llm.conftest import TEXTS

DOCS = [(i, t) for i, t in enumerate([
    "the cat sat on the mat", "The cat sat", None, "", "a rat sat on a hat, the fat cat", "Zebra ÉTÉ été zebra", "the the the",
    "unseen wörds entirely", "mat hat cat rat", "the cat sat on the mat"])]


def brute_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ppm(train, text, order, discount=0.5):
    """Symbol by symbol, with dictionaries: contexts of every length, escapes, exclusion."""
    symbols = lambda words: [1 + b for b in " ".join(words).encode()] + [257]
    counts = {}
    for words in train:
        s = [0] * order + symbols(words)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(tuple(s[i - k:i]), Counter())[s[i]] += 1
    s, total = [0] * order + symbols(text), 0.0
    for i in range(order, len(s)):
        excluded, p = set(), 1.0
        for k in range(order, -1, -1):
            seen = {x: n for x, n in counts.get(tuple(s[i - k:i]), {}).items() if x not in excluded}
            if not seen:
                continue
            whole = sum(seen.values())
            if s[i] in seen:
                p *= (seen[s[i]] - discount) / whole
                break
            p *= discount * len(seen) / whole
            excluded |= set(seen)
        else:
            p /= 257 - len(excluded)
        total += math.log10(p)
    return total


@pytest.mark.parametrize("order", [2, 6])
def test_scores_against_brute_force(spark, order):
    df = spark.createDataFrame([(i, t, "?", 1) for i, t in DOCS] + [(0, DOCS[0][1], "?", 1)], "doc_id long, text string, row string, n long")
    train = (F.col("doc_id") != 7) & (F.col("doc_id") != 8)
    rows = ppm.score(df, train, settings=ppm.Settings(order=order, frequent=20), doc_id=F.col("doc_id")).collect()
    assert len(rows) == len(DOCS) + 1
    held = [brute_tokens(t) for i, t in [*DOCS, DOCS[0]] if i not in (7, 8)]
    c = Counter(w for words in held for w in [*words, ""])
    n, v = sum(c.values()), len(c)
    for r in rows:
        words = brute_tokens(DOCS[r.doc_id][1])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(c[w] > 0 for w in [*words, ""]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words, ""]), abs=1e-9)
        assert r.score == pytest.approx(brute_ppm(held, words, order), abs=1e-9), (order, words)


@pytest.mark.parametrize("order, nodes", [(0, 0), (1, 12), (3, 12), (6, 0), (6, 12)])
def test_rare_spans_count(spark, monkeypatch, order, nodes):
    """Whether a span is among the few that travel to the workers decides nothing, nor do parts, rows and waits of any size."""
    for name, value in (("GROUPS", 3), ("LONG_ROW", 5), ("WAITING", 20), ("WINDOW", 16)):
        monkeypatch.setattr(ppm, name, value)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab Äz") for _ in range(rng.randrange(40))) for _ in range(40)] + [None, "", "qqq"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ppm.score(df, F.col("doc_id") % 3 != 0, settings=ppm.Settings(order=order, nodes=nodes), doc_id=F.col("doc_id")).collect()
    held = [brute_tokens(t) for i, t in enumerate(texts) if i % 3]
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert r.score == pytest.approx(brute_ppm(held, brute_tokens(texts[r.doc_id]), order), abs=1e-9)


def test_counts_travel_packed(spark, monkeypatch):
    """Rows between tasks grow with slots and bytes, not with words and spans; what a slot got has one count."""
    monkeypatch.setattr(ppm, "SLOTS", 7)
    monkeypatch.setattr(ppm, "SPREAD", 2)
    rng = random.Random(5)
    texts = [" ".join(f"W{rng.randrange(3000)}" for _ in range(rng.randrange(200))) for _ in range(60)] + [None, "", "é  x"]
    rows = ppm.count(spark.createDataFrame([(t,) for t in texts], "text string"), ppm.Settings()).collect()
    assert sorted(r.slot for r in rows) == list(range(-7, 2 * 7))
    words = [(w, n) for r in rows if r.slot < 0 for w, n in zip(r.codes.split(b" "), np.frombuffer(r.n, np.int64).tolist(), strict=True)]
    split = [brute_tokens(t) for t in texts]
    assert len(words) == len(dict(words)) and dict(words) == Counter(w.encode() for x in split for w in [*x, ""])
    assert sum(r.total for r in rows if r.slot >= 0) == sum(len(" ".join(x).encode()) + 1 for x in split)
    spans = [c for r in rows if r.slot >= 0 for c in np.frombuffer(r.codes, np.uint64).tolist()]
    assert len(spans) == len(set(spans)) == sum(r.size for r in rows if r.slot >= 0)
    assert all(len(r.codes) == len(r.n) == 8 * r.size and sum(np.frombuffer(r.n, np.int64)) == r.total for r in rows if r.slot >= 0)


@pytest.mark.parametrize("frequent", [1, 20])
def test_rare_words_and_ends_are_looked_up(spark, monkeypatch, frequent):
    """An end that is not frequent is looked up like any other word; waits, slots and homes of any size decide nothing."""
    for name, value in (("GROUPS", 3), ("SLOTS", 5), ("SPREAD", 2), ("WORDS_WAITING", 7), ("HOME", 3), ("WINDOW", 16)):
        monkeypatch.setattr(ppm, name, value)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "bb", "Ünï", "d" * 70, "e5"]) for _ in range(rng.randrange(12))) for _ in range(30)] + [None, "new newer new"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = ppm.score(df, F.col("doc_id") % 3 != 1, settings=ppm.Settings(frequent=frequent), doc_id=F.col("doc_id")).collect()
    held = [brute_tokens(t) for i, t in enumerate(texts) if i % 3 != 1]
    c = Counter(w for words in held for w in [*words, ""])
    n, v = sum(c.values()), len(c)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        words = brute_tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(c[w] > 0 for w in [*words, ""]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words, ""]), abs=1e-9)
        assert r.score == pytest.approx(brute_ppm(held, words, 6), abs=1e-9)
    counts = ppm.count(df.where(F.col("doc_id") % 3 != 1), ppm.Settings()).where("slot < 0")
    travel = {w.encode(): math.log10(x + 0.5) for w, x in c.items() if x * frequent >= n}  # long ones too
    assert ppm.frequent_words(counts, n, ppm.Settings(frequent=frequent)) == pytest.approx({ppm.short_name(w): x for w, x in travel.items()})
    assert frequent == 1 or b"d" * 70 in travel


def trie_of(texts, order, least):
    spans = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [0] * order + [1 + b for b in t] + [257]
        for i in range(order, len(s)):
            for k in range(order + 1):
                spans[k][sum(x << ppm.BITS * j for j, x in enumerate(reversed(s[i - k:i + 1])))] += 1
    nodes, contexts = [], []
    for c in spans:
        up = Counter()
        for code, n in c.items():
            up[code >> ppm.BITS] += n
        for out, d in ((nodes, c), (contexts, up)):
            kept = sorted((k, n) for k, n in d.items() if n >= least)
            out.append((np.array([k for k, _ in kept], np.uint64), np.array([n for _, n in kept], np.int64)))
    return ppm.Trie(order, nodes, contexts)


@pytest.mark.parametrize("least", [1, 2, 5, 10_000])
def test_probabilities_add_up_with_a_bounded_trie(least):
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abcde ") for _ in range(rng.randrange(60))) for _ in range(40)]
    scorer = ppm.Scorer(trie_of(texts, 3, least))
    for _ in range(60):
        context = sum(rng.choice([0, 1 + ord("a"), 1 + ord("b"), 1 + ord(" "), 200]) << ppm.BITS * k for k in range(3))
        p = 10 ** scorer.log_p(np.uint64(context << ppm.BITS) | np.arange(1, 258, dtype=np.uint64))
        assert p.min() > 0 and p.sum() == pytest.approx(1, abs=1e-9)


def test_windows_do_not_change_scores(monkeypatch):
    texts = [b"abc abd abe", b"", b"a" * 300, b"xyz"]
    scorer = ppm.Scorer(trie_of(texts, 3, 1))
    whole = scorer.scores(texts)
    monkeypatch.setattr(ppm, "WINDOW", 7)
    assert scorer.scores(texts) == pytest.approx(whole)


def test_table_finds_all_keys():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 62, 5000).astype(np.uint64))
    table = ppm.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (ppm.Table(keys[:0]).find(keys) == -1).all()


def test_scores_of_odd_rows(docs, no_docs):
    rows = ppm.score(docs, F.lit(True), doc_id=F.col("doc_id")).collect()
    assert len(rows) == len(TEXTS) and all(r.score < 0 for r in rows)
    nothing = ppm.score(docs, F.lit(False), doc_id=F.col("doc_id")).collect()
    assert {r.train_tokens for r in nothing} == {0} and {r.n_known for r in nothing} == {0}
    assert min(r.n_tokens for r in nothing) == 1
    assert all(r.score == pytest.approx(-math.log10(257) * (len(" ".join(brute_tokens(dict((i, t) for i, t, *_ in TEXTS)[r.doc_id]).copy()).encode()) + 1))
               for r in nothing)
    assert ppm.score(no_docs, F.lit(True)).collect() == []


def brute_language(text, model):
    """Counts n-gram by n-gram, then the votes of the duels of each level, margins breaking ties; the least sure duel of the winners."""
    grams = Counter()
    b = [c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in b" " + text.encode() + b" "]
    for k in model.settings.orders:
        for i in range(len(b) - k + 1):
            code = 0
            for c in b[i:i + k]:
                code = (code << 8 | c) & 0xFFFFFFFF
            grams[((code ^ k * 0x01010101) * 2654435761 & 0xFFFFFFFF) >> 32 - model.settings.bits] += 1
    length = math.sqrt(sum(grams.values()))
    margin = {pair: sum(float(w[g]) * math.sqrt(n) / length for g, n in grams.items()) + float(c)
              for pair, w, c in zip(model.pairs, model.weights, model.offsets)}

    def duel(level, classes):
        points = {}
        for x in classes:
            own = [m if a == x else -m for (l, a, b), m in margin.items() if l == level and x in (a, b)]
            won = [a == x if m >= 0 else b == x for (l, a, b), m in margin.items() if l == level and x in (a, b)]
            points[x] = sum(won) + 1e-3 * sum(map(math.tanh, own)), min([1 / (1 + math.exp(-4 * m)) for m in own], default=1.0)
        best = max(sorted(classes), key=lambda x: points[x][0])
        return best, points[best][1]

    chosen, sure = duel("family", {langid.family(x) for x in model.languages})
    language, sure_too = duel(chosen, {x for x in model.languages if langid.family(x) == chosen})
    return language, min(sure, sure_too)


def test_votes_and_duels_against_brute_force(spark):
    """Eight languages of four families, two of them alone in theirs; texts mix languages, so that some duels are close."""
    rng = random.Random(3)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(40)] for x, letters in {
        "es": "aeiorst", "fr": "aeiouqul", "it": "aeiozc", "de": "enrsch", "en": "thewing", "sv": "åäörk", "fi": "yäkkai", "zz": "xqj"}.items()}
    say = lambda *langs: " ".join(rng.choice(words[rng.choice(langs)]).title() for _ in range(rng.randrange(3, 25)))
    train = spark.createDataFrame([(i, say(x), x) for i in range(12) for x in words], "doc_id long, text string, lang string")
    model = langid.fit(train, "text", "lang", "doc_id", langid.Settings(bits=12, epochs=4))
    assert len([p for p in model.pairs if p[0] == "family"]) == 6 and len(model.pairs) == 12
    texts = [say(*rng.sample(sorted(words), rng.choice([1, 2, 3]))) for _ in range(150)]
    rows = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, doc_id=F.col("doc_id")).collect()
    assert len(rows) == len(texts) and len({r.lang_pred for r in rows}) == len(words)
    for r in rows:
        language, score = brute_language(texts[r.doc_id], model)
        assert r.lang_pred == language and r.score == pytest.approx(score, abs=1e-5)


def test_deobfuscation():
    counts = Counter()
    for w in ("idiot moron pathetic loser clown scum worthless " * 3 + "the lost mother is a nice lot in town this round other cross").split():
        code, n = toxicity.letter_trigrams(w)
        counts.update(dict(zip(code.tolist(), n.tolist())))
    reader = toxicity.Reader(toxicity.language_model(counts, {}, 0.0))
    for written, plain in [("1d10t", "idiot"), ("IDI0T!!", "idiot"), ("m0r0n", "moron"), ("p@th3tic", "pathetic"), ("l-o-s-e-r,", "loser"), ("$cum", "scum"),
                           ("cl0wwwwn", "clown"), ("idiooooot", "idiot"), ("you i d i o t of", "idiot"), ("w0rthless", "worthless")]:
        assert plain in reader.words(written), written
    assert reader.words("plain words, only.") == {"plain", "words", "only"} and reader.words("") == set()
    assert "x" * 500 in reader.words("x" * 500)


def reading():
    counts = Counter()
    for w in ("idiot moron pathetic loser clown scum worthless stupid " * 3 + "the lost mother is a nice lot in town this round other cross you are so very").split():
        code, n = toxicity.letter_trigrams(w)
        counts.update(dict(zip(code.tolist(), n.tolist())))
    return toxicity.language_model(counts, {}, 0.0)


def test_words_of_any_length_are_decoded():
    reader = toxicity.Reader(reading(), {"stupid": 5.0, "idiot": 4.0})
    spelled = " ".join("you are so very nice but the " * 2 + "stupid" + " mother of this round town is lost").replace("   ", " ")
    for text in ("stuuuupid", "$tup1d", "s t u p i d", "stu" + "u" * 60 + "pid", "$tup1d" + "!" * 40, spelled, "x-" * 70 + "$tup1d" + "-y" * 70,
                 " ".join("the" * 40 + "stupid" + "mother" * 40), "stupid", "$tup1d ", "!" * 200 + "$tup1d"):
        assert reader.features(text)[0] == 5.0, text
    for text in ("the nice town", "a b c", "x" * 500, "1 2 3 4 5 6", "t h e n i c e t o w n " * 30, "q9-" * 400):
        assert reader.features(text)[0] == 0.0, text


def enumerated(token, trigrams):
    """Every path through the lattice: plain form and its best log probability."""
    paths = {("", 0, 0): 0.0}
    for ch, n in toxicity.runs_of(token):
        forms = [(c, 0.0) for c in (ch if ch.isalpha() else "")] + [(c, toxicity.SUBSTITUTE) for c in toxicity.LOOKALIKES.get(ch, "")]
        options = [(c, p + (0.0 if n == 1 else toxicity.COLLAPSE * (2 if n == 2 else 1))) for c, p in forms]
        options += [(c + c, p + (toxicity.COLLAPSE if n > 2 else 0.0)) for c, p in forms if n > 1]
        if not ch.isalpha():
            options.append(("", toxicity.DROP * (1 if ch in toxicity.MARKS or ch == " " else 3)))
        after = {}
        for (said, x, y), p in paths.items():
            for form, cost in options:
                a, b, q = x, y, p + cost
                for c in form:
                    z = toxicity._letter(c)
                    q += trigrams.get(toxicity._code(a, b, z), toxicity.UNKNOWN)
                    a, b = b, z
                key = (said + form, a, b)
                after[key] = max(q, after.get(key, -math.inf))
        paths = after
    best = {}
    for (said, a, b), p in paths.items():
        best[said] = max(p + trigrams.get(toxicity._code(a, b, 0), toxicity.UNKNOWN), best.get(said, -math.inf))
    return best


def test_decoder_against_enumeration():
    trigrams, rng = reading(), random.Random(9)
    for _ in range(300):
        token = "".join(rng.choice("stupidonm1!0$@3-*7") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 8)))
        best = enumerated(token, trigrams)
        assert best[toxicity.decode(token, trigrams)] == pytest.approx(max(best.values())), token


def test_toxicity_held_out(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.where(~held), labels, corpus=docs)
    lang = docs.where("lang = 'en'").join(labels, "doc_id")
    rows = toxicity.score(lang.where(held), model, toxic=F.col("toxic")).collect()
    right = [r.toxic == r.predicted for r in rows]
    assert sum(right) >= 0.9 * len(right) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 1), (5, 0, 0), (5, 0, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == len(TEXTS)
    for part in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, part)).collect()} == {0.0}
    kept = toxicity.without_toxic(docs, toxicity.fit(docs, labels.limit(0)))
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).collect() == []


TURNS = [(1, 0, "user", "hi </turn> \\ ### <|endoftext|> : é😀"), (1, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "a second one"),
         (1, None, "system", None), (2, 0, None, "no role"), (2, 1, "assi: stant", "x" * 50_000), (None, 5, "assistant", "\\"), (3, 0, "user", ""), (3, 0, "user", "")]


def test_chat_round_trip(spark):
    path = bpe.default_path()
    df = spark.createDataFrame([(*t, "?") for t in TURNS], "conv_id long, turn long, role string, text string, ids string")
    formatter, made = chat.Formatter(path), chat.format_turns(df, path).collect()
    reserved = set(formatter.reserved)
    for r in made:
        role, text, loss, written = formatter.read(r.ids, r.mask)
        assert (role, text) == (r.role_key, r.text_key) and loss == (text if role == "assistant" else "")
        assert [i for i in r.ids if i in reserved] == [formatter.open, formatter.says, formatter.close] and 50256 not in r.ids
        body = written[len(chat.OPEN):-len(chat.CLOSE)]
        assert not re.search(r"(?<!\\)(\\\\)*(</?turn>|###|<\|endoftext\|>)", body)
    want = {}
    for c, turn, role, text in sorted(TURNS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        w = want.setdefault(c, ["", "", 0])
        w[0] += f"{role or ''}\n{text or ''}\n"
        w[1] += (text or "") if role == "assistant" else ""
        w[2] += 1
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df, path), path).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {c: (r.turns_sha256, r.loss_sha256, r.loss_chars, r.n_turns) for c, r in got.items()} == {
        c: (sha(a), sha(b), len(b), n) for c, (a, b, n) in want.items()}
    assert chat.digests(chat.format_turns(df.limit(0), path), path).collect() == []
