"""Merkle manifests, token alignment and WARC archives against plain versions, and round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandmark.llm import merkle, queries, token_alignment, warc

A, B = queries.TOKENIZER_A, queries.TOKENIZER_B


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"text {i} é", "en", "a", 5 + i) for i in range(37)]
    rows += [(3, "text 3 é", "en", "a", 8), (3, "other", "en", None, 8), (None, "no id", "en", "b", 1), (5, None, "fr", None, None), (7, "", None, "", 0), (8, "x", None, "c", 1), (9, "y", "", "c", 1), (10, "z", "ß", "c", None)]
    cols = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx string, run string, digest string, leaf string, n string"
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], cols)


# 11


def manifest_by_hand(rows):
    item = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, n: sha(*map(item, (r["doc_id"], r["source"], r["lang"], n, r["text"])))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def siblings(tree, i):
        for row in tree[:-1]:
            yield i & 1, row[i ^ 1] if i ^ 1 < len(row) else ""
            i >>= 1

    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((leaf(r, r["n_chars"]), r))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for k in names:
        by[k].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    trees = {k: levels([x[0] for x in by[k]]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for rank, k in enumerate(names):
        for i, (own, r) in enumerate(by[k]):
            way = [*siblings(trees[k], i), *siblings(top, rank)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            at = leaf(r, r["n_chars"] + 1) if hit else own
            for left, x in way:
                at = sha(x, at) if left else sha(at, x)
            out.append((r["doc_id"], own, trees[k][-1][0], top[-1][0], sha(*(x for _, x in way)), at, at == top[-1][0]))
    return out


@pytest.mark.parametrize("height", [12, 2])
def test_manifest(spark, odd, tmp_path, height, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, manifest_by_hand(odd.collect())))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_nothing_and_of_one(spark, odd):
    assert merkle.checked(odd.limit(0), F.lit(False)).collect() == []
    one = merkle.checked(odd.where("lang is null and doc_id = 7"), F.lit(False)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == [] and one["verified"]


def test_octopus():
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 64, 100):
        rows = [[sha(str(i)) for i in range(n)]]
        while len(rows[-1]) > 1:
            rows.append([sha(*rows[-1][i : i + 2]) for i in range(0, len(rows[-1]), 2)])
        for _ in range(20):
            wanted = rng.sample(range(n), rng.randint(1, n))
            need = merkle.octopus(wanted, n)
            have = {(0, i): rows[0][i] for i in wanted} | {(level, i): rows[level][i] for level, i in need}
            assert merkle._climb(dict(have), wanted, n) == rows[-1][0]
            for x in need:  # none of them can be spared
                with pytest.raises(KeyError):
                    merkle._climb({k: v for k, v in have.items() if k != x}, wanted, n)


def test_proofs_of_some_leaves(spark, odd, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 3)
    rows = odd.select("doc_id", "lang", merkle.leaf_of().alias("leaf"))
    leaves, nodes = merkle.manifest(rows)
    some = merkle.proofs(leaves.where("idx % 5 = 2"), nodes, keep=("doc_id",))
    got = some.withColumn("ok", merkle.folded(F.col("digest"), F.col("proof")) == F.col("root")).collect()
    assert len(got) == 8 and all(r["ok"] for r in got) and len({r["root"] for r in got}) == 1


# 12


def groups_by_hand(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letter = {v: k for k, v in token_alignment.BYTE_OF.items()}
    byte = {v: k for k, v in letter.items()}
    docs = []
    for text in texts:
        groups = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
            bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
                ea, eb = ends(ba), ends(bb)
                last = 0
                for cut in sorted(set(ea) & set(eb)):
                    groups.append(([i for i, e in zip(ia, ea, strict=True) if last < e <= cut], [i for i, e in zip(ib, eb, strict=True) if last < e <= cut]))
                    last = cut
        docs.append(groups)
    held = Counter(p for d in docs for p in {(x, y) for ga, gb in d for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for d in docs:
        pairs = [(x, y) for ga, gb in d for x in ga for y in gb]
        line = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in d)
        out.append((sum(len(g[0]) for g in d), sum(len(g[1]) for g in d), len(d), len(pairs), sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs), sha(line) if d else ""))
    return out


def test_token_alignment(spark, tmp_path):
    rng = random.Random(5)
    words = "the quick Brown fox naïve façade 東京 🙂🙂 don't 12345 x=y; <|endoftext|> </s> <0x41> Zürich über ....... a\tb \n\n".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [None, "", " ", "x", "two  spaces", "▁ piece mark", "é", "\x00 nul", " lead and trail ", "東京都" * 200, "qz" * 3000, texts[0], texts[0]]
    df = spark.createDataFrame([(i % 70, t, "k", "b") for i, t in enumerate(texts)], "doc_id long, text string, keys string, block string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_token_alignment(spark, str(tmp_path)).collect()
    want = [(i % 70, *x) for i, x in enumerate(groups_by_hand(texts))]
    assert sorted(map(tuple, got)) == sorted(want)
    small = token_alignment.align_documents(df, A, B, digest=True, block_bytes=500)
    assert sorted(map(tuple, small.collect())) == sorted(want)


def test_large_groups_and_maps(spark, monkeypatch):
    text = "Donaudampfschifffahrtsgesellschaft 東京 " * 3
    df = spark.createDataFrame([(1, text), (2, text), (3, "a")], "doc_id long, text string")
    whole = sorted(map(tuple, token_alignment.align_documents(df, A, B).collect()))
    listed = {(r["a"], r["b"]): (r["n"], r["best"]) for r in token_alignment.vocabulary_map(df, A, B).collect()}
    pair = token_alignment.loaded(A, B)
    before = token_alignment.aligned(pair, [text, "a"])
    monkeypatch.setattr(token_alignment, "LISTED", 0)
    after = token_alignment.aligned(pair, [text, "a"])
    for k in ("at", "keys", "times"):
        assert before[k].tolist() == after[k].tolist()
    groups = [g.split("|") for g in whole[0][-1].split(";")]
    assert {(int(x), int(y)) for a, b in groups for x in a.split(",") for y in b.split(",")} <= set(listed)
    assert max(n for n, _ in listed.values()) == 2 and any(best for _, best in listed.values())
    assert token_alignment.align_documents(df.limit(0), A, B).collect() == []


def test_run_skipping():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 60)
        density = rng.random()
        cuts = [[i for i in range(1, n) if rng.random() < density] + [n] for _ in range(2)]
        if rng.random() < 0.5:
            cuts[1] = sorted({*cuts[0], n} - set(rng.sample(cuts[0][:-1], len(cuts[0][:-1]) // 4)))
        total, odd = token_alignment.irregular(*cuts)
        both, last, want = sorted(set(cuts[0]) & set(cuts[1])), 0, []
        for g, c in enumerate(both):
            sizes = tuple(sum(last < e <= c for e in x) for x in cuts)
            want += [(g, *sizes)] if sizes != (1, 1) else []
            last = c
        assert (total, odd) == (len(both), want)


def test_long_text(spark):
    long = "lorem ipsum dolor sit amet " * 80_000  # 2 MB
    got = token_alignment.align_documents(spark.createDataFrame([(1, long), (2, "lorem")], "doc_id long, text string"), A, B, digest=True).collect()
    assert {r["doc_id"] for r in got} == {1, 2} and min(r["n_groups"] for r in got) > 0


# 13


def pages_of(spark):
    big = "<p>" + "text of a page " * 100 + "</p>"
    nested = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" + "\0" * 5 + big
    rows = [(i, f"http://h{i % 7}.example.com/p/{i % 11}?q={i % 3}#x", f"<p>{i}</p>" + big * (i % 4)) for i in range(120)]
    rows += [(200, "http://a.b/", big), (201, "http://a.b/", big), (150, None, big), (None, "http://c.d:8080/x", big), (202, "https://u@C.D/x\ny", None), (203, "", ""), (204, "nothing", "short"), (205, "nothing", "short"), (206, "ftp://é.org", nested), (207, "http://a.b", nested), (207, "http://a.b", nested)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, archive string")


def warc_by_hand(rows):
    most = defaultdict(list)
    for r in rows:
        most[(r["html"] or "").encode()].append(r["page_id"])
    out = []
    for r in rows:
        data = (r["html"] or "").encode()
        first = max((x for x in most[data] if x is not None), default=None)
        again = len(data) >= 1000 and first is not None and r["page_id"] != first
        out.append((r["page_id"], len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


@pytest.mark.parametrize("sizes", [(4 << 20, 3000, 256), (3000, 4, 2)])
def test_warc(spark, tmp_path, sizes, monkeypatch):
    for name, n in zip(("ARCHIVE_BYTES", "BLOCK", "STRIDE"), sizes, strict=True):
        monkeypatch.setattr(warc, name, n)
    pages = pages_of(spark)
    pages.repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op13_warc_index(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, warc_by_hand(pages.collect())))


def test_warc_lookup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 5)
    monkeypatch.setattr(warc, "STRIDE", 3)
    monkeypatch.setattr(warc, "MEMBER", 700)
    pages = pages_of(spark)
    path = warc.write_archives(pages, str(tmp_path / "w"))
    index = warc.build_index(spark, path)
    for url in ("http://h3.example.com/p/5?q=0", "http://a.b/", None, "http://nowhere.org/"):
        key = warc.url_key(url)
        found = warc.fetch(spark, path, warc.lookup(index, spark.createDataFrame([(url,)], "url string")), payload=True)
        got = {(r["page_id"], r["url"]): r["payload"] for r in warc.replayed(found).collect()}
        want = [r for r in pages.collect() if warc.url_key(r["url"]) == key]
        assert sorted(map(str, got)) == sorted({str((r["page_id"], r["url"])) for r in want})
        for r in want:
            if got[r["page_id"], r["url"]] is not None:
                assert bytes(got[r["page_id"], r["url"]]) == (r["html"] or "").encode()


def test_warc_files_are_gzip_members(spark, tmp_path):
    import gzip

    path = warc.write_archives(pages_of(spark), str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").rglob("part-*"))
    assert raw.count(b"WARC/1.1\r\nWARC-Type") >= 131 and path


def test_warc_long_and_none(spark):
    long = "".join(random.Random(1).choices("abcdefgh <>", k=20 << 20))
    pages = spark.createDataFrame([(1, "http://a/", long), (2, "http://b/", long)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in warc.stored(pages).collect()) == [(1, 20 << 20, 2), (2, 20 << 20, None)]
    assert warc.stored(pages.limit(0)).collect() == []


def test_url_keys():
    assert warc.url_key("http://www.Example.com/A?b#c") == "com,example,www)/A?b"
    assert warc.url_key("https://x.org:443") == "org,x)/" and warc.url_key("http://u:p@x.org:81/a") == "org,x:81)/a"
    assert warc.url_key("//x.org?q") == "org,x)/?q" and warc.url_key("mailto:a#b") == "mailto:a"
