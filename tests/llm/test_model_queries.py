"""Whole queries of the fitted operators against plain versions, word by word and row by row, on the fitted numbers."""

import math
import random
import re
import zlib

import numpy as np

from sluice.llm import language_id, quality, toxicity

SPACE_WORD, WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = {"aa": "abcdefgé", "bb": "efghijkñ", "cc": "stuvwxyz", "dd": "日本語中文字"}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def texts(seed, n=90):
    """(doc_id, text, lang): one language, mixtures of two to four, and odd ones."""
    r, out = random.Random(seed), []
    for i in range(n):
        used = r.sample(sorted(LETTERS), r.choice([1, 1, 1, 2, 3, 4]))
        words = [w for lang in used for w in ("".join(r.choices(LETTERS[lang], k=r.randrange(2, 7))) for _ in range(r.choice([3, 40, 90])))]
        out.append((i, " ".join(words), used[0] if len(used) == 1 and i % 9 else None))
    x = out[3][1]
    return [*out, (900, None, "aa"), (901, "", None), (902, "123 ... !", "bb"), (903, x, None), (903, x, None), (None, x.upper(), None), (904, "é", None), (905, (x + " ") * 300, None)]


def bins(text):
    b = lowered(" " + text + " ").encode()
    return [(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 17 for i in range(len(b) - 2)]


def plain_languages(docs):
    counts: dict = {}
    for doc_id, text, lang in docs:
        if lang is not None and text is not None and not is_held_out(doc_id):
            for x in bins(text):
                counts.setdefault(lang, {}).setdefault(x, 0)
                counts[lang][x] += 1
    names = sorted(counts)
    sums = [sum(counts[n].values()) for n in names]
    p = lambda x: np.array([(counts[n].get(x, 0) + 0.5) / (s + 0.5 * (1 << 15)) for n, s in zip(names, sums)])

    def mixture(probabilities, n, pi):
        for _ in range(10):
            new = np.zeros(len(pi))
            for q, k in zip(probabilities, n):
                new += k * q * pi / (q @ pi)
            pi = new / sum(n)
        return pi, sum(k * math.log(q @ pi) for q, k in zip(probabilities, n))

    out = []
    for doc_id, text, _ in docs:
        if text is None or not any(c.isalpha() for c in text):
            out.append((doc_id, "und", 0.0, set()))
            continue
        found: dict = {}
        for x in bins(text):
            found[x] = found.get(x, 0) + 1
        probabilities, n = [p(x) for x in found], list(found.values())
        alone = sum(k * np.log(q) for q, k in zip(probabilities, n))
        best, value, score = {int(alone.argmax()): 1.0}, alone.max(), float(1 / np.exp(alone - alone.max()).sum())
        every, _ = mixture(probabilities, n, np.full(len(names), 1 / len(names)))
        order = sorted(range(len(names)), key=lambda i: -every[i])
        for size in range(2, len(names) + 1):
            pi = np.zeros(len(names))
            pi[order[:size]] = every[order[:size]] + 1e-3
            pi, likely = mixture(probabilities, n, pi / pi.sum())
            likely -= 3.0 * (size - 1) * math.log(max(sum(n), 2))
            if likely > value:
                best, value, score = {i: x for i, x in enumerate(pi) if x > 0}, likely, float(pi.max())
        out.append((doc_id, names[max(best, key=lambda i: best[i])], score, {names[i] for i in best}))
    return out


def test_language_query(spark):
    docs = texts(1)
    rows = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, source string").repartition(3)
    got = sorted(language_id.report(rows).collect(), key=lambda x: (str(x.doc_id), x.score))
    want = sorted(plain_languages(docs), key=lambda x: (str(x[0]), x[2]))
    assert len(got) == len(want)
    for x, (doc_id, lang, score, languages) in zip(got, want):
        assert (x.doc_id, x.held_out, x.lang_pred, set(x.languages)) == (doc_id, is_held_out(doc_id), lang, languages)
        assert abs(x.score - score) < 1e-6


def plain_features(text):
    data = text.encode()
    words = SPACE_WORD.findall(text)
    if not words:
        return None
    n, size = len(words), len(data)
    low = [lowered(w) for w in words]
    letter = lambda w: any(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in w.encode())
    symbol = lambda b: b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b == 32 or 9 <= b <= 13) and chr(b) not in ".,;:'\"()-"
    lines = [x for x in re.split("[\n\r]", text) if x]
    lengths = [len(w.encode()) for w in words]
    return [
        math.log1p(n), sum(lengths) / n, len(set(low)) / n, sum(a == b for a, b in zip(low, low[1:])) / n, sum(65 <= b <= 90 for b in data) / size, sum(48 <= b <= 57 for b in data) / size, sum(map(symbol, data)) / size,
        sum(symbol(w.encode()[-1]) for w in words) / n, sum(not letter(w) for w in words) / n, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), max(lengths) / size, (len(set(zip(low, low[1:]))) + 1) / n,
    ]


def plain_quality(docs, model):
    w, mean, scale = model
    evidence, groups = [], {}
    for _, text, host, path in docs:
        x = plain_features(text or "")
        e = None
        if x:
            x = np.clip(np.array(x), -20, 20)
            z = np.concatenate([x, [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]])
            e = float(np.clip((z - mean) / scale @ w[:-1] + w[-1], -30, 30))
            g = groups.setdefault((host, path), [0, 0.0])
            g[0], g[1] = g[0] + 1, g[1] + 1 / (1 + math.exp(-e))
        evidence.append(e)
    total = sum(n for n, _ in groups.values())
    centre = min(max(sum(s for _, s in groups.values()) / total, 1e-3), 1 - 1e-3)

    def strength(rows):
        n = sum(x for x, _, _ in rows)
        if n <= len(rows):
            return 1e6
        mean = sum(x * c * (1 - c) for x, _, c in rows) / n
        between = max((sum(x * (r - c) ** 2 for x, r, c in rows) - len(rows) * mean) / n, 1e-9)
        return min(max(mean / between - 1, 1.0), 1e6)

    hosts: dict = {}
    for (host, _), (n, s) in groups.items():
        h = hosts.setdefault(host, [0, 0.0])
        h[0], h[1] = h[0] + n, h[1] + s
    k = strength([(n, s / n, centre) for n, s in hosts.values()])
    rate = {h: (s + k * centre) / (n + k) for h, (n, s) in hosts.items()}
    k = strength([(n, s / n, rate[h]) for (h, _), (n, s) in groups.items()])
    logit = lambda x: math.log(x / (1 - x))
    out = []
    for (doc_id, _, host, path), e in zip(docs, evidence):
        if e is None:
            out.append((doc_id, 0.0, False))
            continue
        n, s = groups[host, path]
        site = logit(min(max((s + k * rate[host]) / (n + k), 1e-3), 1 - 1e-3)) - logit(centre)
        score = 1 / (1 + math.exp(-(e + quality.WEIGHT * site)))
        out.append((doc_id, score, score >= 0.5))
    return out


def test_quality_query(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(150):
        junk = r.random() < (0.8 if i % 5 == 0 else 0.2)
        words = ["".join(r.choices("abcdefghé", k=r.randrange(1, 9))) for _ in range(r.choice([8, 60, 200]))]
        text = "\n".join("!# ".join(words).upper().split("C")) * r.randrange(1, 3) if junk else "\n".join([" ".join(words).capitalize() + "."] * r.choice([1, 1, 2]))
        docs.append((i, text, f"h{i % 5}" if i % 11 else None, f"p{i % 3}" if i % 13 else None))
        labels.append((i, int(not junk) if i % 7 else None, None))
    docs += [(500, None, "h0", "p0"), (501, " \t\n", "h1", "p1"), (502, "one", "alone", "p0"), (2, docs[2][1], "h2", "p2"), (None, docs[4][1], "h0", "p0"), (503, docs[6][1] * 200, "h1", "p1")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(rows, known)
    monkey = quality.learn
    quality.learn = lambda *_: model  # the order of a sample may change the fit's last digits
    try:
        got = sorted(((x.doc_id, x.score, x.keep) for x in quality.assess(rows, known).collect()), key=str)
    finally:
        quality.learn = monkey
    want = sorted(plain_quality(docs, model), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-6


def plain_scores(docs, model, hash_of):
    """Maximal segments by their definition: the best one of a stretch, then what is left and right of it."""

    def split(scores, base):
        if not scores or max(scores) <= 0:
            return []
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), x[1], x[2]))
        i = -best[2]
        j = i - best[1]
        return [*split(scores[:i], base), (base + i, base + j, best[0]), *split(scores[j:], base + j)]

    table = dict(zip(model.table.tolist(), model.scores.tolist()))
    out = []
    for doc_id, text in docs:
        scores = []
        for w in WORD.findall(lowered(text or "")):
            whole = table.get(hash_of(w), model.other)
            stem = table.get(hash_of(w[:4]) ^ 0x5555555555555555, model.other) if len(w) > 4 else -math.inf
            scores.append(max(whole, stem))
        base = math.log(toxicity.K_FACTOR * max(1, len(scores)))
        values = [v for _, _, s in split(scores, 0) if (v := model.rate * s - base) > toxicity.LEAST]
        x = np.array([max(values, default=0.0), math.log1p(sum(values)), math.log1p(len(values))])
        w, mean, scale = model.curve
        out.append((doc_id, float(1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30))))))
    return out


def test_toxicity_query(spark):
    from sluice.llm import kernel as K

    r = random.Random(9)
    bad, fine = [f"vile{i}" for i in range(12)] + ["bad"], ["".join(r.choices("abcdefgh", k=r.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(240):
        words = r.choices(fine, k=r.choice([5, 40, 80]))
        if i % 6 == 0:
            at = r.randrange(len(words))
            words[at:at] = r.choices(bad, k=r.randrange(2, 9))
        if i % 10 == 1:
            words.insert(0, r.choice(bad))
        docs.append((i, " ".join(words).title() if i % 2 else ", ".join(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(900, None), (901, ""), (902, "..."), (3, docs[3][1]), (None, docs[6][1])]
    rows, known = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(rows, known)
    assert len(model.table) and model.curve is not None

    def hash_of(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(K.hash_spans(raw, np.array([0]), np.array([len(raw)]), lower=True)[0])

    got = sorted(((x.doc_id, x.score) for x in toxicity.assess(rows, model).collect()), key=str)
    want = sorted(plain_scores(docs, model, hash_of), key=str)
    assert [a[0] for a in got] == [a[0] for a in want]
    assert max(abs(a[1] - b[1]) for a, b in zip(got, want)) < 1e-6
