"""Each operator against a plain version of what it is to compute."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandmark.llm import common, decontamination, fingerprints, html_text, lm_scoring, mixing, near_dedup, pii, quality, queries, substring_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(3000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and then some more words follow it here", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and then some more words follow it here", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and then some more words follow it here", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "   \n\t ", "en", "b", 4),
    (6, "one", "en", None, 3),
    (7, LONG, "en", "c", 1),
    (None, "no id but a text that says the quick brown fox jumps over the lazy dog and then some more words follow it here", "en", "c", 1),
    (8, LONG + " tail", "fr", "c", 1),
    (9, "é" * 60 + " ÄÖ " + "é" * 60, "fr", "d", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long, score string, word string, block string, node string, size string"
    return spark.createDataFrame([(*r, "x", "y", "z", "n", "s") for r in ODD], cols)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(r):
    return str(r)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# 1


def base_scores(rows, held):
    toks = [(i, [w.translate(LOWER) for w in WORD.findall(t or "")] + ["\n"]) for i, t in rows]
    c = Counter(w for (i, ws) in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return n, [(i, len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_lm_base(which, request):
    df = request.getfixturevalue(which)
    held = lambda i: i is not None and crc(i) % 7 == 2
    n, want = base_scores(rows_of(df), held)
    got = lm_scoring.score_documents(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, block_bytes=60_000).collect()
    assert {r["train_tokens"] for r in got} == {n}
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got), key=key) == sorted(((i, a, b, round(s, 4)) for i, a, b, s in want), key=key)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)


def ctw_by_hand(train, depth):
    """P(bit | node, context) of the weighted trees, by recursion on counts."""
    counts = defaultdict(lambda: [0, 0])
    for text in train:
        s = b"\n" * depth + text
        for i in range(depth, len(s)):
            for j in range(8):
                node, bit = (256 | s[i]) >> (8 - j), (s[i] >> (7 - j)) & 1
                for d in range(depth + 1):
                    counts[(s[i - d : i], node)][bit] += 1
    kids = defaultdict(set)
    for ctx, node in counts:
        if ctx:
            kids[(ctx[1:], node)].add(ctx)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def log_w(ctx, node):
        if (ctx, node) not in memo:
            own = log_kt(*counts[(ctx, node)])
            if len(ctx) < depth:
                below = sum(log_w(c, node) for c in kids[(ctx, node)])
                memo[(ctx, node)] = (math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below))), own - below)
            else:
                memo[(ctx, node)] = (own, None)
        return memo[(ctx, node)][0]

    def p_one(past, node, d=0):
        ctx = past[len(past) - d :]
        if (ctx, node) not in counts:
            return 0.5
        a, b = counts[(ctx, node)]
        kt = (b + 0.5) / (a + b + 1)
        if d == depth:
            return kt
        log_w(ctx, node)
        w = 1 / (1 + math.exp(-memo[(ctx, node)][1]))
        return w * kt + (1 - w) * p_one(past, node, d + 1)

    def score(text):
        s, total = b"\n" * depth + text, 0.0
        for i in range(depth, len(s)):
            for j in range(8):
                p = p_one(s[i - depth : i], (256 | s[i]) >> (8 - j))
                total += math.log10(p if (s[i] >> (7 - j)) & 1 else 1 - p)
        return total

    return score


def test_lm_score_is_the_weighted_mixture(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "tha", "an", "and", "é", "of"]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    norm = {i: b" ".join(t.encode().lower().split()) + b"\n" for i, t in rows}
    score = ctw_by_hand([norm[i] for i, _ in rows if i % 4], 3)
    got = lm_scoring.score_documents(df, F.col("doc_id") % 4 == 0, depth=3, block_bytes=300).collect()
    assert len(got) == 40
    for r in got:
        assert abs(r["score"] - score(norm[r["doc_id"]])) < 1e-3
        assert abs(r["bits_per_byte"] + r["score"] * math.log2(10) / len(norm[r["doc_id"]])) < 1e-9


def test_lm_hot_ids(spark):
    """One id, or none, for most rows: blocks are dealt by text too, and scores don't depend on it."""
    rows = [(None if k % 2 else 1, f"some words of row {k} " * 9) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (lm_scoring.score_documents(df, F.lit(False), depth=3, block_bytes=b).collect() for b in (1 << 20, 700))
    assert sorted(round(r["score"], 2) for r in few) == sorted(round(r["score"], 2) for r in many) and len(many) == 60


def test_lm_beats_words_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = lm_scoring.score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.95 * got[1]


# 2


def test_fingerprints(docs, odd):
    for df in (docs, odd):
        rows = sorted(((i, t or "") for i, t in rows_of(df)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
        want = []
        for k, (i, t) in enumerate(rows):
            n, nxt = len(t), rows[(k + 1) % len(rows)][1]
            want.append((i, n, hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()))
        got = fingerprints.fingerprints(df).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
        by_text = defaultdict(set)
        texts = {}
        for i, t in rows:
            texts.setdefault(i, t)
        for r in got:
            by_text[texts[r["doc_id"]]].add(r["fingerprint"])
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_ranges_agree(docs, monkeypatch):
    whole = sorted(map(tuple, fingerprints.fingerprints(docs).collect()))
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 20_000)
    assert sorted(map(tuple, fingerprints.fingerprints(docs).collect())) == whole


def test_phrases_are_lz78():
    text, phrases, w = "abababcabcabcdabcde", [], ""
    for ch in text:
        w += ch
        if w not in phrases:
            phrases.append(w)
            w = ""
    ends, _ = fingerprints.phrase_ends(text, 4, "zz")
    assert [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] == phrases
    _, edited = fingerprints.phrase_ends(text, 4, "zzabc")
    assert edited == fingerprints.phrase_ends("ababzzabc", 9, "")[0]


# 3


def contamination_by_hand(docs, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if w]
    windows = defaultdict(set)
    for item, t in items:
        ws = split(t)
        for k in range(max(1, len(ws) - 9) if ws else 0):
            windows[tuple(ws[k : k + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        ws, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if own := windows.get(tuple(ws[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark, sf_dir, docs, odd):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert sorted(map(tuple, decontamination.contamination(docs, bench).collect())) == sorted(contamination_by_hand(rows_of(docs), items))
    mine = [(1, "Lazy dog"), (10, "brown FOX jumps"), (2, "one"), (3, None), (4, "..."), (5, "then some more words follow it here no"), (5, LONG[:400]), (6, "Lazy dog")]
    small = spark.createDataFrame(mine, "item_id long, text string")
    got = sorted(map(tuple, decontamination.contamination(odd, small).collect()), key=key)
    assert got == sorted(contamination_by_hand(rows_of(odd), mine), key=key)
    near = decontamination.proximity_matches(odd, small, 3).where("window = 'lazy dog'").collect()
    assert {r["doc_id"] for r in near} == {1, 2, None}


@pytest.mark.parametrize("slop", [0, 2, 7])
def test_proximity(spark, slop):
    import random

    rng = random.Random(slop)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    items = [("x", "a b a c"), ("y", "h g f e d"), ("z", "a"), ("w", "a zz")]
    got = decontamination.proximity_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), slop, 5)
    want = set()
    for i, t in rows:
        words = t.split()
        for item, w in items:
            asked = Counter(w.split())
            for k in range(len(words)):
                span = words[k : k + len(w.split()) + slop]
                if words[k] in asked and not asked - Counter(span):
                    want.add((i, w, k, (item,)))
    assert {(r["doc_id"], r["window"], r["start"], tuple(r["items"])) for r in got.collect()} == want and want


def test_contamination_by_shuffle(spark, docs, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.contamination(docs, bench).collect()))
    monkeypatch.setattr(common, "MOST_ROWS", 0)
    assert sorted(map(tuple, decontamination.contamination(docs, bench).collect())) == whole


# 4


def test_quality(spark, docs):
    big = "/root/testdata/sf0.01"
    got = quality.classify(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet"))
    marks = spark.read.parquet(f"{big}/labels.parquet")
    held = got.where("held_out").join(marks, "doc_id").collect()
    assert len(held) > 40 and all(0 <= r["score"] <= 1 for r in held)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in held)


def test_quality_odd(spark, odd):
    marks = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.classify(odd, marks).count() == len(ODD)
    assert quality.classify(odd, marks.limit(0)).count() == len(ODD)
    assert quality.keep_good(odd, marks).columns == odd.columns


# 5


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap = {s: 2.0 * sizes[s] for s in order}
    left, target, fixed = 1.5 * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        room = left - sum(cap[s] for s in fixed)
        target = {s: cap[s] if s in fixed else room * w[s] / sum(w[x] for x in free) for s in order}
        over = [s for s in free if target[s] > cap[s]]
        if not over:
            return target
        fixed |= set(over)


def test_mixing(docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "text", "source").collect()
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        want = targets_by_hand(sizes)
        got = mixing.mix(df.select("doc_id", "text", "source")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
            assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
            rate = r["target"] / r["source_size"] if r["source_size"] else 0
            assert math.floor(rate + 1e-9) <= r["copies"] <= math.ceil(rate - 1e-9)
        assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert mixing.emitted(docs).count() == sum(r["copies"] for r in mixing.mix(docs).collect())


def test_mixing_beside_other_columns(spark):
    rows = [(k, "a b c", "s" if k % 3 else None, 777, "t", k, "own") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Size long, target string, copies long, copy string")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "text", "source", "copy", "size", "source_size", "target", "copies"] and {r["size"] for r in got.collect()} == {3}
    out = mixing.emitted(df)
    assert out.columns == ["doc_id", "text", "source", "Size", "target", "copies", "copy"]
    n = {r["doc_id"]: r["copies"] for r in got.collect()}
    assert sorted((r["doc_id"], r["Size"], r["target"], r["copies"], r["copy"]) for r in out.collect()) == sorted((k, 777, "t", k, c) for k, m in n.items() for c in range(1, m + 1))


def test_names_that_clash(spark):
    rows = [(1, "one two three four five six", "s"), (1, "one two three four five six", "s"), (None, "seven eight nine", None), (None, "another text of some words", "s")]
    names = ["_id", "_node", "_n", "kept_id", "kept_node", "kept_n", "kept_null", "__id", "__found", "found", "found_id", "matches", "n_words", "_mix_of", "mix_of", "mix_size", "of", "m", "a.b"]
    df = spark.createDataFrame([(*r, *names) for r in rows], ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` string" for n in names)]))
    bench = spark.createDataFrame([("a", "one two three four five six")], "item_id string, text string")
    assert sorted(r["text"] for r in near_dedup.keep_one(df).collect()) == sorted({r[1] for r in rows})
    got = decontamination.uncontaminated(df, bench)
    assert got.columns == df.columns and sorted(r["text"] for r in got.collect()) == ["another text of some words", "seven eight nine"]
    assert mixing.mix(df).count() == 4 and set(mixing.emitted(df).columns) == {*df.columns, "copy"}


def test_mixing_of_rows_without_ids(spark):
    rows = [(None if i % 2 else i, f"w{i} " * 3, "abc"[i % 3]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.05 * r["target"] for r in got)


# 6

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;text<br>goes on.<div class="ad-box"><p>Buy now</p></div><p>Second
   block &lt;x&gt; &#233;.</p><p>z</p><form><input type=text><button>Send</button></form><section class="comments"><p>Nice one!</p></section></article>
<aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst bold text goes on.\nSecond block <x> é.\nz"
    assert html_text.main_text("") == "" and html_text.main_text("<nav>menu</nav>") == ""
    assert html_text.main_text("<p>a<p>b <i>c</i>") == "a\nb c"
    assert html_text.main_text("just text") == "just text"


def test_main_text_is_whole():
    long, end = "word " * 600, "closing " * 50
    both = f"{long.strip()}\n{end.strip()}"
    assert html_text.main_text(f"<h1>Head</h1><div class=share>Share</div><p>{long}</p><div class=ad>Buy</div><p>{end}</p>") == f"Head\n{both}"
    links = "".join(f"<li><a href=/{k}>source {k}</a></li>" for k in range(5))
    assert html_text.main_text(f"<p>{long}</p><ul>{links}</ul><p>{end}</p>").split("\n")[1:6] == [f"source {k}" for k in range(5)]
    assert html_text.main_text(f"<html><head><meta charset=x><title>T</title><style>p</style><body><p>{long}</p><p>{end}</p>") == both
    assert html_text.main_text(f"<head><title>T</title><template><p>no</p></template><p>{long}</p><p>{end}</p>") == both
    assert html_text.main_text(f"<p>{long}</p><article class=card>Teaser</article><p>{end}</p>") == f"{long.strip()}\nTeaser\n{end.strip()}"
    assert html_text.main_text(f"<p>Outside</p><article><p>{long}</p></article>") == long.strip()


def test_windows_decide_without_marks():
    text, light = "A sentence of the story that goes on for a while. " * 8, "tiny"
    lines = [light] * 6 + [text, text, "short", text] + [light] * 6
    page = "".join(f"<p>{t}</p>" for t in lines)
    # two light lines share a window with heavy ones at either end; what is further out is below the level
    assert html_text.main_text(page).split("\n") == [light] * 2 + [text.strip(), text.strip(), "short", text.strip()] + [light] * 2
    assert len(html_text.main_text("".join(f"<p>{light}</p>" for _ in range(9))).split("\n")) == 9
    two = f"<article><p>{text}</p><p>{text}</p></article><article><p>teaser</p></article>"
    assert html_text.main_text(two).split("\n") == [text.strip()] * 2
    # one more paragraph outside doesn't turn the page around
    assert html_text.main_text(f"<p>{text[:260]}</p>" + two).split("\n") == [text.strip()] * 2
    assert html_text.main_text(f"<article><p>{text}</p><p>x</p></article>").split("\n") == [text.strip(), "x"]


def test_blocks_stay_whole():
    page = "<article><p>before<script>x()</script>\n after and <svg><path d=M0/><text>no</text></svg>icon, <math><mi>x</mi></math> <button>Go</button>end.</p></article>"
    assert html_text.main_text(page) == "before after and icon, x end."
    assert html_text.main_text("<article><p class=social-history>a b</p><p class='share-price'>c</p><menu><li>d</li></menu></article>") == "a b\nc\nd"
    assert html_text.main_text("<section><p>a</p><div class=ad>x<p>b</p></section><p>c</p>") == "a\nc"
    assert html_text.main_text("<article><p>a</p><div class=ad>x<p>b</p></article>") == "a"
    assert html_text.main_text("<article><p>a</p><div class='comments'><p>" + "long reader comment " * 20 + "</p></div><ul><li>b<li>c <a href=x>d</a></ul></article>") == "a\nb\nc d"


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html_text.extract(pages.unionByName(spark.createDataFrame([(None, None, None)], pages.schema))).collect()
    assert len(got) == pages.count() + 1
    for page, r in zip(pages.collect(), got, strict=False):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page["html"], re.S)[1]
        # in these pages p and h1 are the only blocks
        blocks = [" ".join(__import__("html").unescape(re.sub(r"<br>", " ", re.sub(r"<!--.*?-->|</?[^b/][^>]*>|</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["page_id"] == page["page_id"] and r["text"].split("\n") == [b for b in blocks if b] and r["n_chars"] == len(r["text"])


# 7


def test_edits_count_as_anew():
    coder, rng = token_counts.Coder.of(queries.TOKENIZER), random.Random(3)
    bits = ["the", " ", "  ", "\n", "'s", "'", "don't", "é", "12", "3", "!?", " a", "\t\t", "x'll", "   y"]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))
        tree = token_counts.Counted(text, coder)
        for _ in range(12):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 2, 7, 40])
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 1, 3, 30])))
            text = text[:a] + new + text[b:] if a <= len(text) else text + new
            tree.edit(a, b, new)
            assert tree.text == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(coder.coder.encode_ordinary(text))
            assert [p for s in tree.segments for p in s] == coder.pieces(text)


def test_edits_are_local():
    coder = token_counts.Coder.of(queries.TOKENIZER)
    tree = token_counts.Counted(LONG, coder)
    tree.edit(9000, 9003, "new")
    assert tree.recoded < 30


def test_a_full_segment_is_split_alone(monkeypatch):
    coder = token_counts.Coder.of(queries.TOKENIZER)
    text = " ".join(f"w{i}" for i in range(5000))
    tree, asked = token_counts.Counted(text, coder), []
    monkeypatch.setattr(coder, "count", lambda p, own=coder.count: asked.append(p) or own(p))
    tree.edit(2000, 2000, " ".join(f"n{i}" for i in range(300)))
    new = text[:2000] + " ".join(f"n{i}" for i in range(300)) + text[2000:]
    assert tree.text == new and tree.n_tokens == len(coder.coder.encode_ordinary(new)) and max(map(len, tree.segments)) <= token_counts.LARGEST
    # what was encoded is told: new pre-tokens, those that they replace, and those of the segment that was split
    assert len(asked) <= tree.recoded + 20 < 1600


def test_trees_are_kept(spark, docs, odd, tmp_path):
    """A written table of trees takes edits in two later jobs, and ends as counted anew."""
    coder = token_counts.Coder.of(queries.TOKENIZER)
    for n, df in enumerate((docs, odd)):
        at = str(tmp_path / str(n))
        token_counts.segment_trees(df, queries.TOKENIZER).write.parquet(f"{at}/0")
        first, second = [(5, 9, "new words"), (0, 0, "x")], [(3, 3, " and more"), (10**9, 10**9, " tail")]
        for k, edits in enumerate((first, second)):
            some = F.array(*(F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop"), F.lit(t).alias("text")) for a, b, t in edits))
            token_counts.edit_trees(spark.read.parquet(f"{at}/{k}").withColumn("edits", some), queries.TOKENIZER).write.parquet(f"{at}/{k + 1}")
        want = []
        for i, t in rows_of(df):
            t = t or ""
            for a, b, new in first + second:
                a, b = min(a, len(t)), min(max(a, b), len(t))
                t = t[:a] + new + t[b:]
            want.append((i, len(t), len(coder.coder.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()))
        got = spark.read.parquet(f"{at}/2").collect()
        assert sorted(((r["doc_id"], r["edited_chars"], r["edited_tokens"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
        assert all("".join(x["text"] for x in r["segments"]) is not None and sum(x["tokens"] for x in r["segments"]) == r["edited_tokens"] for r in got)
        long = [r for r in got if r["edited_chars"] > 4000]
        assert all(r["n_recoded"] < 40 for r in long)


def test_count_edits(docs, odd):
    for df in (docs, odd):
        got = token_counts.count_edits(df.withColumn("edits", token_counts.sample_edits()), queries.TOKENIZER).collect()
        coder = token_counts.Coder.of(queries.TOKENIZER).coder
        edits = {r["text"]: r["edits"] for r in df.select("text", token_counts.sample_edits().alias("edits")).collect()}
        want = []
        for i, t in rows_of(df):
            new = t or ""
            for e in edits[t] or []:
                lo = min(max(e["start"] or 0, 0), len(new))
                hi = min(max(e["stop"] or 0, lo), len(new))
                new = new[:lo] + (e["text"] or "") + new[hi:]
            want.append((i, len(t or ""), len(coder.encode_ordinary(t or "")), len(new), len(coder.encode_ordinary(new)), hashlib.sha256(new.encode()).hexdigest()))
        assert sorted(((r["doc_id"], r["n_chars"], r["n_tokens"], r["edited_chars"], r["edited_tokens"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)


# 8


def classes_by_hand(rows, least=0.8):
    def bag(t):
        w = (t or "").translate(LOWER).encode().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    bags = {t or "": bag(t) for _, t in rows}
    where = defaultdict(list)
    root = {t: t for t in bags}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for t, b in bags.items():
        near = Counter()
        for s in b:
            for o in where[s]:
                near[o] += min(b[s], bags[o][s])
            where[s].append(t)
        for o, shared in near.items():
            if shared / (sum(b.values()) + sum(bags[o].values()) - shared) >= least:
                root[find(t)] = find(o)
    members = defaultdict(list)
    for i, t in rows:
        members[find(t or "")].append(i)
    out = []
    for m in members.values():
        ids = [i for i in m if i is not None]
        out += [(i, min(ids, default=None), len(m)) for i in m]
    return out


def test_near_classes(spark, odd):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (big, odd):
        got = near_dedup.classes(df).collect()
        assert sorted(map(tuple, got), key=key) == sorted(classes_by_hand(rows_of(df)), key=key)
    assert near_dedup.keep_one(odd).columns == odd.columns


def test_signature_is_unbiased():
    a = [b" ".join(b"w%d" % (i * 7 % 50) for i in range(k, k + 60)) for k in (0, 8)]
    rng = random.Random(1)
    found = []
    for _ in range(60):
        salt = b"%d" % rng.getrandbits(40)
        doc, h, c = near_dedup.bags([t.replace(b"w", salt) for t in a])
        sig = near_dedup.signatures(doc, h, c, 2)
        found.append((sig[0] == sig[1]).mean())
        x, y = ((h[doc == k], c[doc == k]) for k in (0, 1))
        want = near_dedup.similarity(x, y)
    assert abs(sum(found) / 60 - want) < 0.02


@pytest.mark.parametrize("edges", [10, 200_000])
def test_components(spark, monkeypatch, edges):
    monkeypatch.setattr(near_dedup, "EDGES", edges)
    rng = random.Random(6)
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    pairs = [p for p in pairs if p[0] != p[1]]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    got = [tuple(r) for r in near_dedup.components(df).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in {x for p in pairs for x in p})


def test_chain_of_links(spark):
    w = [f"t{i}" for i in range(400)]
    rows = [(k, " ".join(w[k * 12 : k * 12 + 220])) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.classes(df).collect())) == sorted(classes_by_hand(rows))


@pytest.mark.parametrize(("whole", "tile", "texts"), [(64, 1024, 1 << 20), (4, 7, 3000)])
def test_shared_passages(spark, monkeypatch, whole, tile, texts):
    """Texts of shared passages, all in one bucket: unlike the bucket's hub, they are still held against each other."""

    sketch = near_dedup._sketch

    def one_bucket(batches):
        import pyarrow as pa

        for b in sketch(batches):
            yield pa.RecordBatch.from_arrays([b["node"], b["doc_id"], pa.array([[7]] * b.num_rows, pa.list_(pa.int64())), b["sig"]], ["node", "doc_id", "bands", "sig"])

    rng = random.Random(4)
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(100)]
    rows = []
    for k in range(12):
        own = rng.sample(range(100), 20)
        copy = [*own[:-1], rng.choice([x for x in range(100) if x not in own])]
        rows += [(10 * k, " ".join(passages[x] for x in own)), (10 * k + 1, " ".join(passages[x] for x in copy)), (10 * k + 2, " ".join(passages[x] for x in rng.sample(range(100), 20)))]
    want = classes_by_hand(rows)
    assert sum(n == 2 for _, _, n in want) == 24
    monkeypatch.setattr(near_dedup, "_sketch", one_bucket)
    monkeypatch.setattr(near_dedup, "WHOLE", whole)
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "TEXTS", texts)
    assert sorted(map(tuple, near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == sorted(want)


def test_alike_is_passed_over_rarely():
    n, p = near_dedup.SIZE, near_dedup.LEAST
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near_dedup.ALIKE)) < 1e-7
    with pytest.raises(ValueError):
        near_dedup.classes(None, 0.7)


def test_group_around_the_threshold(spark):
    """A large group of copies with edits, alike in part only: every link of 0.8 counts, whoever the buckets' first members are."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(120)] = f"e{k}x{rng.random()}"
        rows.append((k, " ".join(w)))
    want = classes_by_hand(rows)
    assert len({c for _, c, _ in want}) > 20
    assert sorted(map(tuple, near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == sorted(want)


def test_keep_one_by_id_and_text(spark):
    t = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcde"]
    rows = [(5, t[0], "x"), (5, t[1], "x"), (5, t[2], "x"), (1, t[1] + " end", "x"), (None, t[3], "x"), (None, t[3], "x"), (None, t[0], "x"), (None, t[3] + " end", "x"), (7, t[4], "z"), (7, t[4], "y"), (8, t[4], "a"), (9, None, "x"), (9, "", "y")]
    got = sorted(map(tuple, near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=key)
    thirds = [r for r in got if r[0] is None]
    assert [r for r in got if r[0] is not None] == sorted([(5, t[0], "x"), (5, t[2], "x"), (1, t[1] + " end", "x"), (7, t[4], "y"), (9, "", "y")], key=key)
    assert len(thirds) == 1 and thirds[0][1] in (t[3], t[3] + " end")


# 9


def repeats_by_hand(rows):
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: math.inf if i is None else i
    for i, b in data:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            least[s] = min(least.get(s, math.inf), order(i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < order(i):
                gone[k : k + 50] = b"\x01" * 50
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_cover():
    for d in range(substring_dedup.PERIOD):
        assert any((a - b) % substring_dedup.PERIOD == d for a in substring_dedup.COVER for b in substring_dedup.COVER)


def test_blocks_are_even(spark):
    """Neither a far outlier, nor a frequent id, nor null ids make a large block; ranks rise with the ids."""
    text = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(900)]
    ids = [k if k < 300 else 1 << 60 if k == 300 else 77 if k < 600 else None for k in range(900)]
    df = spark.createDataFrame(list(zip(ids, text, strict=True)), "doc_id long, text string")
    rows, n = common.blocked(df, 4000)
    got = rows.collect()
    size, ranks = Counter(), defaultdict(set)
    for r in got:
        size[r["block"]] += len(r["text"])
        ranks[r["doc_id"]].add(r["block"] // common.PARTS)
    assert len(got) == 900 and n > 40 and max(size.values()) < 4 * 4000
    assert all(len(v) == 1 for v in ranks.values())
    order = [max(ranks[i]) for i in sorted(i for i in ranks if i is not None)] + [max(ranks[None])]
    assert order == sorted(order)
    least = {}
    twice = df.unionByName(df.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat(F.lit("zz "), "text").alias("text")))
    out = substring_dedup.remove_repeats(twice, True, 4000).collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4]).decode()) for r in out), key=key) == sorted(repeats_by_hand(rows_of(twice)), key=key)


@pytest.mark.parametrize("block", [30_000, 8 << 20])
def test_repeats(spark, odd, block):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    rng = random.Random(9)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    made = [(i, "".join(base[a : a + n] + rng.choice("xyz") for a, n in ((rng.randint(0, 2900), rng.choice([10, 48, 49, 50, 51, 70, 200])) for _ in range(5)))) for i in range(60)]
    for df in (big, odd, spark.createDataFrame(made, "doc_id long, text string")):
        got = substring_dedup.remove_repeats(df, True, block).collect()
        assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4]).decode()) for r in got), key=key) == sorted(repeats_by_hand(rows_of(df)), key=key)


# 10


def base_by_hand(text):
    def valid(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
            return 12 <= len(d) <= 19 and total % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    found = []
    for k, (kind, p) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text) if valid(kind, m[0])]
    found.sort()
    return found


def test_personal_data(docs, spark):
    rng = random.Random(2)
    bits = ["a@b.c", "@", "x.y@z-1.com.org", "1.2.3.4", "999.1.1.1.5", "4111 1111 1111 1111", "+", "+49 (30) 123-4567", "1", ".", "-", " ", "a", "é", "4111111111111111", "IBAN ", "DE89 3704 0044 0532 0130 00", "http://u:p@h/x", "٣"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for t in made + [t or "" for _, t in rows_of(docs)]:
        got = [s for s in pii.find(t) if s[1] < 4]
        assert got == [x[:3] for x in base_by_hand(t)]
    for r in pii.personal_data(docs).collect():
        want = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base_by_hand(dict(rows_of(docs))[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    rows = spark.createDataFrame([(1, "a@b.cd, IBAN DE89 3704 0044 0532 0130 00, next"), (None, None)], "doc_id long, text string")
    got = pii.personal_data(rows).collect()
    assert got[0]["spans"] == "email:0:6,account:13:40" and got[1]["spans"] == "" and got[0]["n_email"] == 1
    assert [r["text"] for r in pii.mask(rows).collect()] == ["[EMAIL], IBAN [ACCOUNT], next", None]


def added(text):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text) if k >= 4]


def test_added_kinds():
    for good, end in (("DE89370400440532013000", "."), ("GB82 WEST 1234 5698 7654 32", " and more"), ("FR14 2004 1010 0505 0001 3M02 606", "")):
        assert added(f"IBAN: {good}{end}") == [("account", good)]
    assert added("IBAN DE88370400440532013000") == [] and added("iban GB82 WEST 1234") == []
    assert added("account no. 12345678 rest") == [("account", "12345678")] and added("accounting 12345678") == []
    assert added("see http://user:pw@host.org/x now") == [("link", "http://user:pw@host.org/x")]
    key = "0123456789abcdef0123"
    assert added(f'token = "{key}" and password: {key}') == [("secret", key)] * 2 and added("token = abc") == [] and added("the token of thanks") == []


# all


def test_empty_tables(spark, docs, sf_dir):
    none = docs.limit(0)
    bench, marks, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels", "pages"))
    for out in (
        lm_scoring.score_documents(none, F.lit(False)),
        fingerprints.fingerprints(none),
        decontamination.contamination(none, bench),
        quality.classify(none, marks),
        mixing.mix(none),
        html_text.extract(pages.limit(0)),
        token_counts.count_edits(none.withColumn("edits", token_counts.sample_edits()), queries.TOKENIZER),
        near_dedup.classes(none),
        substring_dedup.remove_repeats(none),
        pii.personal_data(none),
    ):
        assert out.collect() == []
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
