"""Operators for training data: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, media, mixing, packing, pii, quality, quotes, simhash, substrings, toxicity
from tidemark.llm.common import connected_components
from tidemark.llm.queries import TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, component_id string"


def docs(spark, rows):
    """Rows of documents, with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", s, len(t or ""), 0.5, "x", "y") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


EDGE = [(1, None, "a"), (2, "", "a"), (3, "same words here and there", None), (3, "same words here and there", None), (None, "no id but words", "b"), (5, "x " * 50_000, "b"), (6, "same words here and there", "a")]


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmno"), 5)) for _ in range(n))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, 2000 + i) for i in range(50)] + [(i, i + 1) for i in range(5000, 5040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [words(rng, 60) for _ in range(12)]
    rows = [(i, t, "a") for i, t in enumerate(base)] + [(100 + i, t + " " + words(rng, k), "a") for i, (t, k) in enumerate(zip(base, (0, 1, 1, 2, 2, 3) * 2, strict=True))] + [(10_001, None, "a"), (10_002, "", "a")]
    d = docs(spark, rows)
    got = simhash.near_duplicates(d).collect()
    f = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got]
    comp = {i: i for i, _, _ in f}
    for _ in f:
        for i, a, _ in f:
            for j, b, _ in f:
                if (a ^ b).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert {i: c for i, _, c in f} == comp
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))


def test_simhash_edges(spark):
    got = simhash.near_duplicates(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and {r.component_id for r in got if r.doc_id in (3, 6)} == {3}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.keep_one(docs(spark, EDGE)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 5] and sum(r.doc_id is None for r in kept) == 1


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


PII = ["", "a@b.c_d@e.f x@y z@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 ++49 (0)30 1234567-89", "\x01a@b.co\x01 é😀 x@y.zz", "DE89 3704 0044 0532 0130 00 iban", "ssn 123-45-6789", "a.b@c..d", "+1" + " " * 50 + "2345678901", "1" * 40, "a" * 20_000, "x@y.z," * 300, "4111111111111111 4111111111111111"]


def base_spans(t):
    out = [("email", 0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", 1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", 2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", 3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, a, b) for k, _, a, b in sorted(out, key=lambda x: (x[2], x[1]))]


def test_pii(spark):
    d = docs(spark, [(i, t, "a") for i, t in enumerate(PII)] + EDGE)
    for r in pii.find_pii(d).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind in pii.BASE] == base_spans(r.text or "")
    found = {r.doc_id: {s.kind for s in r.pii} for r in pii.find_pii(docs(spark, [(1, PII[5], "a"), (2, PII[6], "a"), (3, "DE89 3704 0044 0532 0130 01", "a")])).collect()}
    assert found == {1: {"iban"}, 2: {"ssn"}, 3: set()}
    clean = pii.redact(d)
    assert clean.columns == d.columns and clean.count() == d.count()
    assert clean.where("text LIKE 'ssn%'").first().text == "ssn <SSN>"
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, words(rng, int(rng.integers(1, 40))), f"s{i % 5}" if i % 7 else None) for i in range(900)]
    got = mixing.mix(docs(spark, rows)).toPandas()
    d = {i: len(t.split()) for i, t, _ in rows}
    assert (got["size"] == got.doc_id.map(d)).all() and len(got) == 900
    src = {i: s for i, _, s in rows}
    got["s"] = [src[i] or "~" for i in got.doc_id]
    g = got.groupby("s").agg(size=("size", "sum"), ss=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (g["size"] == g.ss).all() and abs(g.target.sum() - g["size"].sum()) < 1e-6
    assert (abs(g.taken - g.target) <= 0.01 * g.target).all() and (got.taken <= 3 * got["size"]).all()
    again = mixing.mix(docs(spark, rows).repartition(3)).toPandas()
    assert got.drop(columns="s").sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    out = mixing.apply_mix(docs(spark, rows))
    assert out.columns == docs(spark, []).columns and sum(d[r.doc_id] for r in out.collect()) == got.taken.sum()


def test_mixing_edges(spark):
    got = mixing.mix(docs(spark, EDGE))
    assert got.count() == len(EDGE) and got.where("taken > 3 * size").count() == 0
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, None, None)])).first().taken == 0
    fill = mixing.water_fill(spark.createDataFrame([("a", 1), ("b", 100), (None, 100)], "source string, source_size long")).collect()
    assert {r.source: round(r.target, 6) for r in fill} == {"a": 3.0, "b": 132.0, None: 66.0}


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rng = np.random.default_rng(4)
    hard = ["a  b", "a \n \nb", " x ", "a  b", "it's  'll x", "<|endoftext|> hi", "a <|endoftext|><|endoftext|>  b <|endoftext", "<|endoftext|>", "é 😀😀 b", "\t \t a", "   ", "x \n", "　 　 　x"]
    rows = [(i, words(rng, int(rng.integers(0, 900))), "a") for i in range(40)] + [(100 + i, x, "a") for i, x in enumerate(hard)] + [(10_001, None, "a"), (10_002, "", "a"), (10_003, "x " * 50_000, "a")]
    got = packing.pack(docs(spark, rows).coalesce(2), TOKENIZER).toPandas()
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x, _ in rows}
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert [x for p in g.ids for x in p] == want[i] and (g.doc_tokens == len(want[i])).all()
        assert g.start.tolist() == [0, *np.cumsum(g.length).tolist()[:-1]]
    assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(got.ids, got.ids_crc32, strict=True))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        n = int(g.length.sum())
        assert g.offset.tolist() == [0, *np.cumsum(g.length).tolist()[:-1]] and n <= 2048 and n & (n - 1) == 0
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0


@pytest.mark.parametrize(("segments", "loss"), [(3, 60), (100, 60), (3, 100), (1, 1), (2, 7)])
def test_packing_limits(segments, loss):
    out = []
    p = packing.Packer(out.append, 100, segments, loss)
    rng = np.random.default_rng(5)
    items = [(i, int(n), int(rng.integers(0, n + 1)) if i % 3 else 0) for i, n in enumerate(rng.integers(1, 100, 300))]
    bears = {i: b for i, _, b in items}
    for i, n, b in items:
        p.add(i, 0, n, b)
    p.finish()
    borne = lambda i, start, n: sum(bears[i] <= x < 100 for x in range(start, start + n))
    assert all(len(s) <= segments and sum(x[2] for x in s) <= 100 and sum(borne(*x) for x in s) <= loss for s in out)
    pieces = sorted(x for s in out for x in s)
    for i, n, _ in items:
        mine = [(start, length) for j, start, length in pieces if j == i]
        assert [start for start, _ in mine] == [0, *np.cumsum([length for _, length in mine])[:-1]] and sum(length for _, length in mine) == n


def test_packing_prompts(spark):
    rng = np.random.default_rng(15)
    rows = [(i % 90, words(rng, int(rng.integers(0, 300))), None if i % 5 == 0 else int(rng.integers(0, 400)), "x") for i in range(120)] + [(None, "y " * 9000, 30, "x"), (None, "y " * 9000, 30, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, prompt int, bears string")
    got = packing.pack(d, TOKENIZER, segments=6, loss=700, prompt_col="prompt").toPandas()
    by = got.groupby("sequence_id").agg(n=("length", "sum"), loss=("loss_tokens", "sum"), k=("length", "size"))
    assert by.n.max() <= 2048 and by.loss.max() <= 700 and by.k.max() <= 6
    want = sum(r.doc_tokens - min(max(r.prompt or 0, 0), r.doc_tokens) for r in spark.createDataFrame([(len(packing.byte_bpe(TOKENIZER)(t)) + 1, p) for _, t, p, _ in rows], "doc_tokens int, prompt int").collect())
    assert got.loss_tokens.sum() == want


def unit_rows(rng, n, d=16):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    x = unit_rows(rng, 60)
    x = np.concatenate([x, x[:30] + rng.normal(scale=0.05, size=(30, 16)), np.repeat(x[:1], 8, 0)])
    lab = [i % 2 for i in range(60)] + [i % 2 for i in range(30)] + [0] * 8
    rows = [(i, [float(v) for v in e], l) for i, (e, l) in enumerate(zip(x, lab, strict=True))]
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, rows[0][1], None), (904, [], 0), (905, [float("inf")] * 16, 0), (906, [None] + [1.0] * 15, 0)]
    got = {r.vec_id: r for r in embeddings.link(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows) + len(bad) and all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _, _ in bad)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.array(lab)[:, None] == np.array(lab)[None])
    np.fill_diagonal(near, False)
    have = np.array([got[i].n_links for i in range(len(x))])
    assert (have <= near.sum(1)).all() and have.sum() >= 0.95 * near.sum()
    assert {got[i].component_id for i in (0, *range(90, 98))} == {0}
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_tiles(spark, monkeypatch):
    """A bucket cut into many tiles counts each link once."""
    monkeypatch.setattr(embeddings, "TILE", 7)
    rng = np.random.default_rng(7)
    x = unit_rows(rng, 1) + rng.normal(scale=0.02, size=(60, 16))
    rows = [(i, [float(v) for v in e], 1) for i, e in enumerate(x)]
    got = embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93).sum() - 60
    assert near == 60 * 59 and sum(r.n_links for r in got) == near and {r.component_id for r in got} == {0}


def test_media_formats():
    import struct

    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(c)) + n + c + struct.pack(">I", zlib.crc32(n + c)) for n, c in ((b"IHDR", b"\0" * 13), (b"IEND", b"")))
    gif = b"GIF89a\1\0\1\0\x80\0\0" + b"\0" * 6 + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    wav = media.to_wav(b"\x80" * 10)
    parts = {"image/png": png, "image/gif": gif, "application/gzip": gzip.compress(b"x" * 100), "application/zip": z.getvalue(), "audio/wav": wav, "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF"}
    blob = b"".join(b"..text.." + p for p in parts.values())
    assert [(f.kind, blob[f.start : f.start + f.length]) for f in media.sniff(blob)] == list(parts.items())
    assert not media.sniff(png[:-1] + b"?") and not media.sniff(b"BM and GIF89a %PDF- PK\x03\x04 RIFFxxxxWAVE")
    assert media.corrected_type(png, "image/jpeg") == "image/png" and media.corrected_type(b"abc", None) == "text/plain" and media.corrected_type(b"\xff\xfe", None) == "application/octet-stream"
    assert media.from_wav(media.to_wav(b"abc")) == b"abc"
    with pytest.raises(ValueError):
        media.from_wav(wav[:-1])


def test_media_texts(spark):
    rows = [*EDGE, (7, "é" * 288, "a"), (8, "magic GIF89a here", "a")]
    got = media.store_texts(docs(spark, rows), with_media=True).collect()
    assert len(got) == len(rows)
    order = lambda r: (repr(r[0]), len((r[1] or "").encode()) if isinstance(r[1], str | None) else r[1])
    for r, (i, t, _) in zip(sorted(got, key=order), sorted(rows, key=order), strict=True):
        raw = (t or "").encode()
        pay = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        assert media.from_wav(bytes(r.media)) == pay and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    d = spark.createDataFrame([(1, bytearray(media.to_wav(b"ab")), "image/png", "old"), (2, None, None, "old")], "id int, b binary, declared string, media_type string")
    a, b = media.inspect(d, "b", "declared").orderBy("id").collect()
    assert a.media_type == "audio/wav" and a.mismatch and b.media_type is None and not b.mismatch


def test_substrings_brute_force(spark):
    rng = np.random.default_rng(8)
    shared = [words(rng, 55).split() for _ in range(4)]
    texts = {}
    for i in range(24):
        parts = [words(rng, int(rng.integers(5, 80))).split() for _ in range(2)]
        texts[i] = " ".join([*parts[0], *(shared[i % 4] if i < 16 else []), *parts[1]])
    texts[50] = " ".join([*shared[0][:30], "changed", *shared[0][31:]])
    rows = [(i, t, "a") for i, t in texts.items()] + [(60, texts[20], "a"), (None, texts[1], "a"), (61, "short text", "a"), (62, None, "a"), (63, "", "a")]
    got = substrings.repeated_passages(docs(spark, rows)).collect()
    linked = {r.doc_id for r in got} | {r.other_id for r in got}
    assert linked == {*range(16), 20, 50, 60}
    cls = {x: r.class_id for r in got for x in (r.doc_id, r.other_id)}
    assert all(cls[i] == i % 4 for i in range(16)) and cls[60] == 20 and cls[50] == 0
    for r in got:
        a, b = (texts.get(i, texts[20]).split()[s:e] for i, s, e in ((r.doc_id, r.start_word, r.end_word), (r.other_id, r.other_start, r.other_end)))
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert abs(len(x & y) / len(x | y) - r.similarity) < 0.02 and r.similarity >= 0.8 and len(a) >= 50
    assert substrings.repeated_passages(docs(spark, [])).count() == 0


def test_compact_windows():
    """Every span of the width or more has its minimum at the centre of exactly the windows that cover it."""
    rng = np.random.default_rng(9)
    h = rng.permutation(200).astype(np.uint64) + np.uint64(1)
    h[90] = 0
    w = list(zip(*(x.tolist() for x in substrings.compact_windows(h, 12)), strict=True))
    for i in range(200):
        for j in range(i + 11, 200):
            hit = [c for a, c, b in w if a <= i <= c <= j <= b]
            assert hit == ([] if i <= 90 <= j else [i + int(np.argmin(h[i : j + 1]))])


def test_passage_beside_a_shorter_run():
    """A shared run just short of a passage doesn't hide a passage in the same interval."""
    rng = np.random.default_rng(15)
    run, passage, *fill = (words(rng, n).split() for n in (49, 50, 30, 30, 30, 30))
    a = substrings.shingles(" ".join([*fill[0], *run, *fill[1], *passage]))
    b = substrings.shingles(" ".join([*fill[2], *run, *fill[3], *passage[:25], "changed", *passage[26:]]))
    found = substrings.matched(a, b, 46, 0.8)
    assert [x[:2] for x in found] == [(109, 155)] and found[0][4] >= 0.8


@pytest.mark.parametrize(("n", "more"), [(60, 5), (70, 6), (80, 8), (90, 10), (96, 12)])
def test_passage_with_an_insertion(n, more):
    """Words inserted into one copy leave a near-duplicate, whichever document has them."""
    rng = np.random.default_rng(n)
    passage, extra, *fill = (words(rng, k).split() for k in (n, more, 30, 30, 30, 30))
    a = substrings.shingles(" ".join([*fill[0], *passage, *fill[1]]))
    b = substrings.shingles(" ".join([*fill[2], *passage[: n // 2], *extra, *passage[n // 2 :], *fill[3]]))
    for x, y, places in ((a, b, (30, 30 + n - 4, 30, 30 + n + more - 4)), (b, a, (30, 30 + n + more - 4, 30, 30 + n - 4))):
        found = substrings.matched(x, y, 46, 0.8)
        assert [f[:4] for f in found] == [places] and found[0][4] >= 0.8


def test_copies_behind_a_variant(spark):
    """Exact copies are found though variants that neither is near to come before them in every group."""
    rng = np.random.default_rng(16)
    rows, pairs = [], []
    for k in range(40):
        passage = words(rng, 60).split()
        for v in range(3):
            other = list(passage)
            for at in (12, 30, 47):
                other[at + v] = "changed" + str(v)
            rows.append((10 * k + v, " ".join([*words(rng, 30).split(), *other, *words(rng, 30).split()]), "a"))
        for v in (5, 6):
            rows.append((10 * k + v, " ".join([words(rng, 30), *passage, words(rng, 30)]), "a"))
        pairs.append((10 * k + 5, 10 * k + 6))
    got = substrings.repeated_passages(docs(spark, rows).repartition(16)).collect()
    cls = {x: r.class_id for r in got for x in (r.doc_id, r.other_id)}
    assert sum(a in cls and cls[a] == cls.get(b) for a, b in pairs) == len(pairs)


def test_window_tiles(spark, monkeypatch):
    """A minimum cut into many tiles loses no link."""
    monkeypatch.setattr(substrings, "TILE", 5)
    rng = np.random.default_rng(17)
    passage = words(rng, 60)
    rows = [(i, " ".join([words(rng, 30), passage, words(rng, 30)]), "a") for i in range(24)]
    got = substrings.repeated_passages(docs(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and {x for r in got for x in (r.doc_id, r.other_id)} == set(range(24))


def test_quotes(spark):
    first = "The parser drops the last line.\nIs that on purpose?"
    second = "On Monday A wrote:\n> The parser drops the last line.\n> Is that on purpose?\n\nNo, it is a defect."
    third = "B wrote:\n> On Monday A wrote:\n>> The parser drops the last line.\n> No, it is a defect.\n\nThanks, fixed."
    rows = [(1, 0, "user", first), (1, 1, "assistant", second), (1, 2, "user", third), (1, 3, "user", "> never said before by anyone\nOwn words."), (2, 0, "user", second), (1, 4, "user", None), (None, 1, "user", second), (2, None, None, "> Is that on purpose?"), (2, 0, "user", second)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("hash", F.lit(1))
    got = quotes.link_conversations(d, implicit=False).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert (by[1, 1].content, by[1, 1].parent_turn, by[1, 1].depth) == ("No, it is a defect.", 0, 1)
    assert (by[1, 2].content, by[1, 2].parent_turn, by[1, 2].thread_turn, by[1, 2].depth) == ("Thanks, fixed.", 1, 0, 2)
    assert (by[1, 3].content, by[1, 3].parent_turn, by[1, 3].n_quotes, by[1, 3].n_linked) == ("Own words.", None, 1, 0)
    assert by[1, 4].content == "" and by[2, 0].parent_turn is None
    assert quotes.link_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t = words(rng, 40).split()
        bad = i % 5 == 0
        if bad:
            t[3], t[20] = ("idiot", "scum") if i % 2 else ("vekqua" + t[3], "vekqub" + t[20])
        out.append((i, " ".join(t), int(bad)))
    return out


def test_toxicity(spark):
    rows = labelled(600, 10)
    d = docs(spark, [(i, t, "a") for i, t, _ in rows] + [(9001, None, "a"), (9002, "", "a"), (None, "plain words", "a")])
    l = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, l).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    y = {i: t for i, _, t in rows}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.97 * len(held) > 90
    kept = toxicity.drop_toxic(d, l)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    plain = toxicity.score(d, l.limit(0)).collect()  # the fixed lexicon alone
    assert all(r.predicted for r in plain if r.doc_id in y and "idiot" in rows[r.doc_id][1])
    assert toxicity.score(docs(spark, []), l).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(11)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.9, 0.02), (0.7, 0.05), (0.6, 0.01))], 1).astype(float)
    votes = np.c_[votes, votes[:, 0]]  # a voter that repeats another
    off, on, prior, weight = toxicity.label_model(votes, np.where(votes[:, 0] > 0, 0.9, 0.05))
    assert abs(prior - 0.2) < 0.03 and np.allclose(on[:3], (0.9, 0.7, 0.6), atol=0.08) and weight[0] < 0.6 and weight[1] > 0.8


def test_quality(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        t = words(rng, 40)
        rows.append((i, t if i % 4 else " ".join(w.upper() + "!!" for w in t.split()), "a"))
    d = docs(spark, rows + [(9001, None, None), (None, "x", "a")])
    l = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(d, l).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got)
    rest = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 400]
    assert sum(r.keep == bool(r.doc_id % 4) for r in rest) >= 0.97 * len(rest)
    assert quality.score(docs(spark, []), l).count() == 0
    assert {r.score for r in quality.score(d, l.limit(0)).collect()} == {0.5}


def test_pipeline(spark, tmp_path):
    """The stages by hand: what each keeps, and that its decisions take effect."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(13)
    rows = labelled(300, 14) + [(500 + i, t, 0) for i, (_, t, y) in enumerate(labelled(20, 14)) if not y] + [(900, "Mail me at jane@example.org today. " + words(rng, 30), 0)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows], cols).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash_dedup", "pii", "mixing", "packing"]
    outs = []
    for _, f in pipeline.STAGES:
        d = f(spark, d, str(tmp_path))
        outs.append(d.toPandas())
        d = spark.createDataFrame(outs[-1], d.schema)
    clean = {i for i, _, y in rows if not y}
    assert {i for i in outs[0].doc_id} == clean and all(list(o.columns) == [c.split()[0] for c in cols.split(", ")] for o in outs[:4])
    assert set(outs[1].doc_id) == {i for i in clean if not 500 <= i < 900}
    assert "<EMAIL>" in outs[2].set_index("doc_id").text[900] and (outs[2].n_chars == outs[2].text.map(len)).all()
    assert outs[3].groupby("doc_id").size().max() <= 3
    assert outs[4].groupby("doc_id").length.sum().sum() == sum(len(packing.byte_bpe(TOKENIZER)(t)) + 1 for t in outs[3].text)
    whole = pipeline.run(spark, str(tmp_path))
    assert whole.count() > 0 and whole.columns == list(outs[4].columns)


def near_copies(rng, bases=20, copies=9, n=60):
    """Bases of n words, each with copies in which one word is another, under ids in any order."""
    texts = []
    for _ in range(bases):
        base = words(rng, n).split()
        texts.append(" ".join(base))
        for at in rng.choice(n, copies, replace=False):
            texts.append(" ".join([*base[:at], "changed" + str(rng.integers(10**6)), *base[at + 1 :]]))
    return [(int(i), t, "a") for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]


def test_substrings_near_copies_brute_force(spark):
    for seed in (31, 32):
        rows = near_copies(np.random.default_rng(seed))
        sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t, _ in rows}  # noqa: B905
        want = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        got = substrings.repeated_passages(docs(spark, rows)).toPandas()
        cls = dict(zip(got.doc_id, got.class_id, strict=True)) | dict(zip(got.other_id, got.class_id, strict=True))
        assert len(want) >= 180 and sum(a in cls and cls[a] == cls.get(b) for a, b in want) >= 0.99 * len(want)
        assert (got.similarity >= 0.8).all()


def test_substrings_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(33)
    shared = [words(rng, 70) for _ in range(4)]
    rows = near_copies(rng, 6, 4) + [(1000 + i, f"{words(rng, 30)} {shared[i % 4]} {words(rng, 40)}", "a") for i in range(60)] + [(5000, words(rng, 40_000) + " " + shared[0], "a"), *EDGE]
    read = lambda: sorted(map(tuple, substrings.repeated_passages(docs(spark, rows)).collect()))
    one = read()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        two = read()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == two and {1000 + i for i in range(60)} | {5000} <= {x for r in one for x in (r[0], r[3])}


def test_components_with_hubs(spark):
    rng = np.random.default_rng(34)
    edges = [(5, 10_000 + i) for i in range(3000)] + [(20_000 + i, 9) for i in range(2500)] + [(12_000, 21_000)] + [(int(a), int(b)) for a, b in rng.integers(30_000, 31_000, (400, 2))]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == 5 for a, b in edges for x in (a, b) if x < 30_000)


def test_mixing_probabilities_differ(spark):
    """Expected copies grow with the square root of the length, and the words taken come near the target."""
    rng = np.random.default_rng(40)
    rows = [(i, words(rng, 4 if i % 2 else 64), f"s{i % 4 // 2}") for i in range(4000)]
    got = mixing.mix(docs(spark, rows)).toPandas()
    got["s"] = got.doc_id % 4 // 2
    for _, g in got.groupby("s"):
        short, long = g[g["size"] == 4].copies.mean(), g[g["size"] == 64].copies.mean()
        assert abs(long / short - 4) < 0.8 or long == 3
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 64


def test_mix_rows_that_differ_elsewhere(spark):
    cols = "doc_id long, text string, source string, lang string, k string, cell int, copies int, row string, copy int"
    rows = [(1, "one two", "a", x, "k", 1, 9, "r", 2) for x in "pqrs"] + [(2, " ", "a", "p", "k", 1, 9, "r", 2), (3, None, None, "p", None, None, None, None, None)] + [(i, "w " * 500, "b", "p", "k", 1, 9, "r", 2) for i in range(10, 30)]
    d = spark.createDataFrame(rows, cols)
    out = mixing.apply_mix(d)
    assert out.columns == d.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows) and max(got.count(r) for r in got) <= 3
    assert {r[3] for r in got if r[0] == 1} == set("pqrs") and all(got.count(r) == 3 for r in rows[:4])  # a stopped source
    assert not {2, 3} & {r[0] for r in got}


@pytest.mark.parametrize("most", [3, 40, 8192])
def test_fingerprint_tiles_dealt_out(spark, most):
    """However many groups a tile is dealt into, links join what all pairs join."""
    rng = np.random.default_rng(41)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(6)])
    fp = np.unique(np.concatenate([near, np.arange(40, dtype=np.uint64)]))
    root = {int(x): int(x) for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fp.tolist()):
        for y in fp[:i].tolist():
            if (x ^ y).bit_count() <= 2:
                root[find(x)] = find(y)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(df, most=most).collect()
    got = {x: x for x in root}
    for r in links:
        a, b = r.a % 2**64, r.b % 2**64
        assert (a ^ b).bit_count() >= 1
        a, b = min(got[a], got[b]), max(got[a], got[b])
        got = {x: a if c == b else c for x, c in got.items()}
    assert len(set(got.values())) == len({find(x) for x in root}) and all((find(x) == find(y)) == (got[x] == got[y]) for x in root for y in list(root)[:50])


def test_keep_one_clashing_names(spark):
    cols = "doc_id long, text string, rid long, fp string, row int, c int, low int, none int"
    rows = [(3, "same words here", 1, "f", 2, 3, 4, 5), (1, "same words here", 1, "f", 2, 3, 4, 5), (1, "same words here", 1, "f", 2, 3, 4, 5), (None, "same words here", 9, "f", 2, 3, 4, 5), (None, "other text of none", 1, "f", 2, 3, 4, 5), (7, "x " * 100_000, 1, None, None, None, None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, cols))
    assert kept.columns == [c.split()[0] for c in cols.split(", ")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[4], rows[5]], key=repr)
    assert simhash.keep_one(spark.createDataFrame([], cols)).count() == 0


def test_embeddings_clashing_names_and_repeats(spark):
    rng = np.random.default_rng(42)
    x = unit_rows(rng, 8, 32)
    cols = "item long, e array<float>, lab string, rep int, same string, vec int, vec_id int, row int, kept_id int, id int"
    rows = [(i if i else None, [float(v) for v in e], "a", 1, "s", 2, 3, 4, 5, 6) for i, e in enumerate(x)]
    rows += [rows[3], rows[3], (100, rows[4][1], *rows[4][2:]), (101, rows[4][1], "b", *rows[4][3:])]
    d = spark.createDataFrame(rows, cols)
    how = {"id_col": "item", "vec_col": "e", "label_col": "lab"}
    got = embeddings.link(d, **how).collect()
    assert len(got) == len(rows)
    assert [r.n_links for r in got if r.item == 3] == [2, 2, 2] and {r.component_id for r in got if r.item in (4, 100)} == {4}
    assert {r.n_links for r in got if r.item in (101, 1, 2)} == {0}
    kept = embeddings.keep_one(d, **how)
    assert kept.columns == d.columns and sorted((r.item for r in kept.collect()), key=repr) == sorted([None, 1, 2, 3, 3, 3, 4, 5, 6, 7, 101], key=repr)


def test_embeddings_large_buckets(spark, monkeypatch):
    """Buckets over many tiles and blocks give the links of all pairs."""
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(43)
    x = unit_rows(rng, 12, 16)
    x = unit_rows(rng, 1, 16) * 0 + np.concatenate([x, np.repeat(x[:2], 150, 0) + rng.normal(scale=0.03, size=(300, 16))])
    rows = [(i, [float(v) for v in e], 1) for i, e in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got.values()) >= 0.97 * want.sum() and all(got[i] <= want[i] for i in got)


def test_posterior_labels_beat_wrong_ones(spark):
    """With a tenth of the training labels turned, unlabelled votes and the label model still give the true classes."""
    rows = labelled(900, 44)
    rng = np.random.default_rng(45)
    d = docs(spark, [(i, t, "a") for i, t, _ in rows])
    known = [(i, 1, y if rng.random() > 0.1 else 1 - y) for i, _, y in rows if i < 450]
    got = {r.doc_id: r.predicted for r in toxicity.score(d, spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()}
    y = {i: t for i, _, t in rows}
    rest = [i for i in y if i >= 450]
    right = sum(got[i] == y[i] for i in rest) / len(rest)
    assert right >= 0.97 > sum(a == y[i] for i, _, a in known) / len(known)


def test_label_model_uses_rows_without_labels():
    """Counts of vote patterns give the same as the rows, and a voter's rates come from all rows, not the labelled ones."""
    rng = np.random.default_rng(46)
    y = rng.random(5000) < 0.15
    votes = np.stack([np.where(y, rng.random(5000) < a, rng.random(5000) < b) for a, b in ((0.9, 0.02), (0.8, 0.03), (0.7, 0.01), (0.5, 0.05))], 1).astype(float)
    few = np.arange(60)
    told = toxicity.rates(votes[few], y[few].astype(float), np.ones(60))
    start = np.where(votes[:, 0] > 0, 0.9, 0.05)
    off, on, prior, weight = toxicity.label_model(votes, start, None, told)
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    assert np.allclose(toxicity.label_model(patterns, np.where(patterns[:, 0] > 0, 0.9, 0.05), n.astype(float), told)[1], on)
    assert np.allclose(on, (0.9, 0.8, 0.7, 0.5), atol=0.06) and abs(prior - 0.15) < 0.02
    q = toxicity.posterior(votes, off, on, prior, weight)
    assert ((q > 0.5) == y).mean() > max((votes[:, k] == y).mean() for k in range(4))


def test_toxicity_edges(spark):
    rows = labelled(200, 47)
    text = rows[0][1]
    d = spark.createDataFrame([(i, t, 1, "r", 2.0) for i, t, _ in rows] + [(0, text, 1, "r", 2.0), (None, None, 1, "r", 2.0), (5000, "fine words " * 30_000 + text, 1, "r", 2.0)], "doc_id long, text string, row int, found string, score double")
    l = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, l).collect()
    assert len(got) == 203 and len({r.score for r in got if r.doc_id == 0}) == 1
    kept = toxicity.drop_toxic(d, l)
    assert kept.columns == d.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.drop_toxic(d.limit(0), l).count() == 0


def test_taught_sums_by_brute_force(spark):
    rng = np.random.default_rng(48)
    feats = [[sorted(set(rng.integers(0, 50, int(rng.integers(0, 9))).tolist())) for _ in range(300)] for _ in range(2)]
    label = rng.integers(-1, 2, 300).tolist()
    df = spark.createDataFrame([(i, q, a, b) for i, (q, a, b) in enumerate(zip(label, *feats, strict=True))], "doc_id long, quality int, a array<short>, b array<short>")
    model = quality.Model([np.append(rng.normal(size=quality.BUCKETS), 0.1) for _ in range(2)], [(1.2, 0.1), (0.8, -0.2)], 0.0, [(0.7, 0.9), (0.5, float("inf"))])
    got = quality.taught(df.repartition(3), model)
    for v in (0, 1):
        for y in (0, 1):
            g, h, n = np.zeros(quality.BUCKETS + 1), np.zeros(quality.BUCKETS + 1), 0
            for i in range(300):
                raw = [sum(model.views[k][f] for f in feats[k][i]) + model.views[k][-1] for k in (0, 1)]
                x = model.curves[1 - v][0] * raw[1 - v] + model.curves[1 - v][1]
                if label[i] < 0 and (x >= model.edges[1 - v][1] if y else -x >= model.edges[1 - v][0]):
                    n += 1
                    at = [*feats[v][i], quality.BUCKETS]
                    g[at] += 1 / (1 + np.exp(-raw[v])) - y
                    h[at] += 0.25
            assert np.allclose(got[v][y][0], g, atol=1e-4) and np.allclose(got[v][y][1], h, atol=1e-4) and got[v][y][2] == n


def test_co_training_teaches(spark):
    """A view that saw few labels learns a feature that only unlabelled rows show, from the other view."""
    rng = np.random.default_rng(49)
    y = rng.integers(0, 2, 4000)
    a = [[10 + int(v)] for v in y]  # the first view tells all rows
    b = [[20 + int(v)] if i < 200 or rng.random() < 0.3 else [30 + int(v)] for i, v in enumerate(y)]  # the second mostly by features without labels
    known = np.arange(4000) < 200
    df = spark.createDataFrame([(i, int(y[i]) if known[i] else -1, a[i], b[i]) for i in range(4000)], "doc_id long, quality int, a array<short>, b array<short>")
    feats = [(np.concatenate(v[:200]), np.ones(200, np.int64)) for v in (a, b)]
    alone, both = (quality.co_train(feats, y[:200].astype(float), lambda m: quality.taught(df, m), k) for k in (0, 3))
    late = [i for i in range(200, 4000) if b[i][0] >= 30]
    values = np.array([b[i][0] for i in late])
    right = [((m.sure([None, (values, np.ones(len(late), np.int64))], 1) > 0) == (y[late] == 1)).mean() for m in (alone, both)]
    assert right[0] < 0.7 and right[1] > 0.95


def test_quality_edges(spark):
    rng = np.random.default_rng(50)
    rows = [(i, words(rng, 30) if i % 3 else "!!! " * 30, "en", "s", 100, 1, "x") for i in range(120)]
    rows += [(5, rows[5][1], "en", "s", 100, 1, "x"), (None, None, None, None, None, 1, "x"), (700, "w " * 60_000, "en", "s", 120_000, 1, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, a string")
    l = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(3, 1, 0), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(d, l).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 5}) == 1
    assert sum(r.keep == bool(r.doc_id % 3) for r in got if r.doc_id is not None and 60 <= r.doc_id < 120) >= 57


def more_media():
    import struct

    jpeg = b"\xff\xd8\xff\xe0\0\x07JFIF\0" + b"\xff\xda\0\x04\1\2" + b"data\xff\0more\xff\xd1end" + b"\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
    webp = b"RIFF" + struct.pack("<I", 4 + 8 + 6) + b"WEBPVP8 " + struct.pack("<I", 5) + b"12345\0"
    flac = b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"\xff\xf8frames"
    page = lambda flag, data: b"OggS\0" + bytes([flag]) + b"\0" * 8 + b"SERI" + b"\0" * 8 + b"\1" + bytes([len(data)]) + data
    return {"image/jpeg": jpeg, "image/bmp": bmp, "image/webp": webp, "application/ogg": page(2, b"one") + page(0, b"two") + page(4, b"three"), "audio/flac": flac}


def test_media_other_formats():
    parts = more_media()
    blob = b"".join(b"..text.." + p for p in parts.values())
    assert [(f.kind, blob[f.start : f.start + f.length]) for f in media.sniff(blob)] == list(parts.items())
    for kind, p in parts.items():
        assert media.corrected_type(p, "text/plain") == kind
        cuts = range(1, len(p)) if kind != "audio/flac" else range(1, 42)
        assert not any(f.kind == kind and f.start == 0 for n in cuts for f in media.sniff(p[:n])), kind
    broken = {"image/jpeg": (2, 0), "image/bmp": (6, 1), "image/webp": (12, 200), "application/ogg": (26, 255), "audio/flac": (4, 3)}
    for kind, (at, byte) in broken.items():
        p = bytearray(parts[kind])
        p[at if kind != "image/webp" else 16] = byte
        assert not [f for f in media.sniff(bytes(p)) if f.start == 0 and f.kind == kind], kind


def test_media_repeated_magic_is_linear():
    import time

    def slow(x):  # without what is kept between hits
        hits = sorted((e - n + 1 - at, k) for e, (k, at, n) in media.automaton().iter(x.decode("latin-1")) if e - n + 1 >= at)
        out, free = [], 0
        for s, k in hits:
            if s >= free and (n := media.VALID[k](x, s, {})):
                out.append((k, s, n))
                free = s + n
        return out

    for unit in (b"%PDF-1", b"PK\x03\x04", b"GIF89a1234567!12" + b"\x40" * 9, b"GIF89a1234567,0123456789", b"OggS", b"fLaC", b"BM"):
        b = time.perf_counter()
        assert media.sniff(unit * (600_000 // len(unit))) == []
        assert time.perf_counter() - b < 5, unit
        rng = np.random.default_rng(51)
        for _ in range(60):  # the same as hit by hit
            x = b"".join(unit if rng.random() < 0.6 else bytes(rng.integers(0, 256, 7, dtype=np.uint8)) + rng.choice([b"%%EOF", b"startxref", b";", b"!", b","]) for _ in range(30))
            assert [tuple(f) for f in media.sniff(x)] == slow(x)


def test_media_of_texts_that_hold_files(spark):
    pdf = "%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF"
    rows = [(1, pdf + " and more", "a"), (2, "before " + pdf, "a"), (3, "plain", "a"), (4, "%PDF-1" * 60_000, "a")]
    got = {r.doc_id: r.feature for r in media.store_texts(docs(spark, rows)).collect()}
    assert got == {1: f"audio/wav,application/pdf,application/pdf:0:{len(pdf)}", 2: f"audio/wav,text/plain,application/pdf:7:{len(pdf)}", 3: "audio/wav,text/plain", 4: "audio/wav,text/plain"}
    d = spark.createDataFrame([(1, bytearray(more_media()["image/bmp"]), "image/png", 3, "x")], "id int, b binary, declared string, row int, found string")
    r = media.inspect(d, "b", "declared").first()
    assert (r.media_type, r.mismatch, r.row, r.found) == ("image/bmp", True, 3, "x")


def mail(rng, n_conv=12, n=14):
    """Messages of which some quote earlier ones (whole or a line, nested, under an attribution or not)."""
    rows = []
    for c in range(n_conv):
        own = []
        for t in range(n):
            lines = [words(rng, int(rng.integers(3, 8))) for _ in range(int(rng.integers(1, 4)))]
            quote = []
            if t and rng.random() < 0.7:
                k = int(rng.integers(0, t))
                which = own[k] if rng.random() < 0.5 else [own[k][int(rng.integers(0, len(own[k])))]]
                quote = ["> " + x.upper() + "!" for x in which]
                if k and rng.random() < 0.4:
                    quote = ["> > " + own[k - 1][0], *quote]
                if rng.random() < 0.5:
                    quote = ["On Monday someone wrote:", *quote]
                quote.append("")
            elif t and rng.random() < 0.2:
                quote = ["> nobody said these words " + words(rng, 3)]
            own.append(lines)
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "\n".join([*quote, *lines])))
    return rows


def test_quotes_brute_force(spark):
    rows = mail(np.random.default_rng(52))
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    want, own = {}, {}
    for c, t, role, text in rows:  # every earlier message is searched for every quoted block, shallowest first
        blocks, mine = [], []
        for line in text.split("\n"):
            m = re.match(r"((?:> ?)+)(.*)", line)
            if m:
                level = m[1].count(">")
                if not blocks or blocks[-1][0] != level:
                    blocks.append((level, []))
                blocks[-1][1].append(m[2])
            elif not line.endswith("wrote:"):
                mine.append(line)
        own[c, t] = "\n".join(mine).strip("\n")
        found = []
        for level, lines in blocks:
            for block in ("\n".join(lines), *[x for x in lines if len(norm(x)) >= 12]):
                said = [k for k in range(t) if norm(block) and norm(block) in {norm(own[c, k]), *(norm(x) for x in own[c, k].split("\n") if len(norm(x)) >= 12)}]
                if said:
                    found.append((level, -said[0]))
                    break
        want[c, t] = -min(found)[1] if found else t - 1 if t else None
    got = quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in got} == want and sum(w != t - 1 for (_, t), w in want.items() if t) > 40
    assert {(r.conv_id, r.turn): r.content for r in got} == own

    def depth(c, t):
        return 0 if want[c, t] is None else 1 + depth(c, want[c, t])

    child = {}
    for (c, t), parent in sorted(want.items()):
        child.setdefault((c, parent), t)

    def head(c, t):
        return t if want[c, t] is None or child[c, want[c, t]] != t else head(c, want[c, t])

    assert all((r.depth, r.thread_turn, r.branch_turn) == (depth(r.conv_id, r.turn), 0, head(r.conv_id, r.turn)) for r in got)
    out = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), piece=3).collect()
    assert sorted((r.conv_id, m.turn) for r in out for m in r.messages) == sorted(own)
    for r in out:
        turns = [m.turn for m in r.messages]
        assert all(want[r.conv_id, b] == a for a, b in zip(turns, turns[1:])) and len(turns) <= 3  # noqa: B905
        assert r.text == "\n".join(f"<|{m.role}|>\n{m.content}" for m in r.messages) and not re.search(r"^>", r.text, re.M)
        if r.piece == 0:
            assert r.answers_turn == want[r.conv_id, r.branch_turn]


def test_quotes_messages_that_share_a_turn(spark):
    rows = [(1, 0, "user", "The first words of all."), (1, 1, "assistant", "> The first words of all.\nYes."), (1, 1, "assistant", "Something else altogether."), (1, 2, "user", "> Something else altogether.\nWhy?"), (1, 2, None, None), (None, 3, "user", "x"), (1, None, "user", "> Yes.\ny"), (2, 0, "user", "z " * 60_000)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, mid int, thread string")
    got = quotes.link_conversations(d, implicit=False).collect()
    by = {r.content[:9]: r for r in got}
    assert (by["Yes."].parent_turn, by["Yes."].depth) == (0, 1) and (by["Something"].parent_turn, by["Something"].depth) == (None, 0)
    assert (by["Why?"].parent_turn, by["Why?"].depth, by["Why?"].thread) == (1, 1, by["Something"].message)
    out = quotes.conversations(d).collect()
    assert sum(len(r.messages) for r in out) == len(rows) and any("<|unknown|>" in r.text for r in out)
    assert quotes.conversations(d.limit(0)).count() == 0


def test_pii_scores_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "call my phone +49 30 1234567-89 or host 1.2.3.4", "a", "b", 1), (2, "+49 30 1234567-89", "a", "b", 1), (3, None, "a", "b", 1)], "doc_id long, text string, pii string, row string, rid int")
    got = {r.doc_id: [(s.kind, round(s.score, 2)) for s in r.found] for r in pii.find_pii(d, out_col="found").collect()}
    assert got == {1: [("phone", 1.0), ("ip", 0.9)], 2: [("phone", 0.7)], 3: []}
    clean = pii.redact(d)
    assert clean.columns == d.columns and [tuple(r) for r in clean.orderBy("doc_id").collect()] == [(1, "call my phone <PHONE> or host <IP>", "a", "b", 1), (2, "<PHONE>", "a", "b", 1), (3, None, "a", "b", 1)]


PIPE = "doc_id long, text string, lang string, source string, n_chars long, row string, rid int, pii string, copies int"


@pytest.mark.parametrize("kind", ["edge", "empty"])
def test_pipeline_edges(spark, tmp_path, kind):
    """Nulls in any column, repeated rows, very long and empty texts, no rows, and columns named as the operators' own."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, "en", s, len(t or ""), "r", 1, "p", 2) for i, t, s in EDGE] + [(None,) * 9, (20, "words of one more document " * 9000, None, None, None, None, None, None, None)]
    rows += [(i, t, "en", "a", len(t), "r", 1, "p", 2) for i, t, _ in labelled(60, 53)]
    spark.createDataFrame(rows if kind == "edge" else [], PIPE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in labelled(60, 53)] + [(None, None, None)] if kind == "edge" else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, f) in enumerate(pipeline.STAGES):
        out = f(spark, d, str(tmp_path))
        if k < 4:
            assert out.columns == d.columns
            out.write.parquet(str(tmp_path / f"stage{k}"))
            d = spark.read.parquet(str(tmp_path / f"stage{k}"))
        else:
            n = out.count()
    assert pipeline.run(spark, str(tmp_path)).count() == n and (n > 0) == (kind == "edge")


def test_stretches_with_too_few_hits_are_not_searched(monkeypatch):
    a, b = np.arange(1, 401, dtype=np.uint64), np.arange(1001, 1401, dtype=np.uint64)
    b[:36] = a[:36]  # 36.8 of 46 are the least
    asked = []
    monkeypatch.setattr(substrings, "_longest", lambda *x: asked.append(x) or (0, 0))
    assert substrings.matched(a, b, 46, 0.8) == [] == substrings._matched_along(a, b, 0, 46, 0.8)
    assert not asked
    b[:46] = a[:46]
    monkeypatch.undo()
    for found in (substrings.matched(a, b, 46, 0.8), substrings._matched_along(a, b, 0, 46, 0.8)):
        assert found and found[0][0] == found[0][2] == 0 and found[0][1] >= 46
    assert substrings._matches(a, b, 46, 0.8) and not substrings._matches(a, b[47:], 46, 0.8)


def test_pairs_of_few_rows_stay_together():
    size, n = 47, 60
    pair, side, doc = np.repeat(np.arange(n), size), np.ones(n * size, np.int64), np.arange(n * size)
    signs = np.full((n * size, 8), np.uint64(0xFF), np.uint64)
    signs[::2] = 0  # every other row shares nothing
    got, seen = [], set()
    for p, q in substrings._near(pair, side, doc, signs, np.arange(n * size), 30):
        assert not seen & set(pair[p].tolist())
        seen |= set(pair[p].tolist())
        got += zip(p.tolist(), q.tolist(), strict=True)
    assert sorted(got) == [(i, j) for k in range(n) for i in range(k * size, (k + 1) * size) for j in range(i + 1, (k + 1) * size) if i % 2 and j % 2]
    one = substrings._near(pair[:size], side[:size], doc[:size], signs[:size], np.zeros(size, np.int64), 30)
    assert not list(one)  # all of one class
    none = np.zeros(0, np.int64)
    assert not list(substrings._near(none, none, none, np.zeros((0, 8), np.uint64), none, 30))


def test_contexts_compared_like_plainly():
    rng, least, similarity = np.random.default_rng(5), 6, 0.8
    x = (rng.integers(0, 30, (700, 11)) * 2 + 1).astype("<u2")
    y = np.where(rng.random((700, 11)) < 0.6, x, np.roll(x, 1, 1)).astype("<u2")
    x[:, :3][rng.random((700, 3)) < 0.3] = 0
    y[:, 8:][rng.random((700, 3)) < 0.3] = 0

    def best(hit, least):
        return max(sum(hit[i:j]) / (j - i) for i in range(len(hit)) for j in range(i + least, len(hit) + 1))

    share, short = 2 * similarity / (1 + similarity), int(similarity * least)
    ok, rest = substrings._aligned(x, y, least, similarity)
    possible = substrings._possible(x, y, least, similarity)
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        hit = [u == v > 0 for u, v in zip(a, b, strict=True)]
        assert ok[i] == any(sum(hit[k:m]) >= share * (m - k) for k in range(11) for m in range(k + least, 12))
        s, t = best([u > 0 and u in b for u in a], short), best([v > 0 and v in a for v in b], short)
        assert possible[i] == (1 / max(s, 1e-3) + 1 / max(t, 1e-3) <= 1 + 1 / similarity + 1e-3)
    assert 0 < ok.sum() < 700 and 0 < possible.sum() < 700 and len(rest)
    bits = np.unpackbits(substrings._signatures(x).view(np.uint8), axis=1)
    assert [b.nonzero()[0].tolist() for b in bits] == [sorted({int(substrings.mix(np.array([v], np.uint64))[0] % np.uint64(substrings.BUCKETS)) for v in a if v}) for a in x.tolist()]
