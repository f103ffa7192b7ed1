"""The training-data operators against brute force, on small tables with awkward rows."""

import base64
import collections
import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash

from larder.llm import (
    byte_bpe, decontaminate, exact_dedup, layout, licences, near_copies, planes, simhash, toxicity, url_reputation, warc,
)
from larder.llm.common import vocabulary
from larder.llm.components import components
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that are named like those the operators add.
CLASH = ", kept string, hash string, score string, token_ids string, spans string, fp string, node string, n string"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def prose(seed, n, vocabulary_size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary_size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty texts, ties, repeated rows, a long text, white space and characters of all kinds."""
    texts = [
        (1, "Some plain text, it's here."), (2, "Some  plain\ttext, it's here."), (3, None), (4, ""), (5, "   "), (None, "alone"),
        (None, "Some plain text, it's here."), (7, "Ünïcode ßtraße 東京 😀😀 \u00a0x\u2003y"), (8, "a" * 5000), (9, "x"),
        (9, "x"), (10, "x"), (11, "\x1c\x1f \x85 z"), (12, prose(1, 30_000)), (13, "one two"), (14, "One two"), (15, "¹²³ ٣٤ Ⅻ"),
        (16, "don't DON'T we'll  \n\n  end "), (9, "y"),
    ]
    return [(i, t, "en", None, None, *["z"] * 8) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS + CLASH.replace(" string", " string")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_exact_duplicates(docs, rows, empty):
    def body(t):
        return re.sub("[\x20\x09-\x0D]+", " ", t or "")

    for hashed in (exact_dedup.content_hash, lambda b: F.unhex(F.lpad(F.hex(F.length(b) % 3), 2, "0"))):
        got = exact_dedup.exact_duplicates(docs, hashed).collect()
        classes = collections.defaultdict(list)
        for r in rows:
            classes[body(r[1])].append(r[0])
        expected = collections.Counter()
        for text, ids in classes.items():
            known = [i for i in ids if i is not None]
            keep = min(known) if known else None
            for i in ids:
                expected[i, keep, len(ids), sha(text)] += 1
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
        assert sum(r.kept for r in got) == len(classes)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)
    assert {(r.doc_id, r.text) for r in kept.collect()} <= {(r[0], r[1]) for r in rows}
    assert (1, "Some plain text, it's here.") in {(r.doc_id, r.text) for r in kept.collect()}
    assert exact_dedup.exact_duplicates(empty).count() == exact_dedup.keep_first(empty).count() == 0


def test_keep_first_with_columns_that_have_no_order(spark):
    rows = [(2, "a  b", {"k": 1}), (1, "a b", {"k": 2}), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first map<string,int>")
    assert sorted((r.doc_id, r.text, r["first"]) for r in exact_dedup.keep_first(df).collect()) == [
        (1, "a b", {"k": 2}), (3, None, None)
    ]


def reference_encoding():
    import public_tokenizers

    with open(vocabulary(byte_bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_tokenizer_library(docs, rows, empty):
    own = reference_encoding()
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs).collect()}
    expected = set()
    for r in rows:
        ids = own.encode_ordinary(r[1] or "")
        expected.add((r[0], len(ids), sha(" ".join(map(str, ids))), sha(r[1] or "")))
    assert got == expected
    assert byte_bpe.round_trip(empty).count() == 0
    coded = byte_bpe.encode_documents(docs)
    assert sorted(coded.columns) == sorted(docs.columns)
    assert byte_bpe.decode_documents(coded).where("cast(decoded as string) != coalesce(text, '')").count() == 0


def test_byte_bpe_on_random_text():
    own, rng = reference_encoding(), random.Random(5)
    encoder = byte_bpe.Encoder(vocabulary(byte_bpe.VOCABULARY), byte_bpe.pattern())
    pool = [chr(c) for c in [*range(256), 0x2028, 0x3000, 0x301, 0x660, 0x4E00, 0x1F600, 0x200D]] + ["  ", "'s", "'ll", " the", "aaaa"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(80)))
        ids = encoder.encode(text)
        assert ids == own.encode_ordinary(text)
        assert encoder.decode(ids).decode() == text
    for text in ("ab" * 4000, " " * 3000, "\n" * 999, "é" * 2000):
        assert encoder.encode(text) == own.encode_ordinary(text)


def test_byte_bpe_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY_PIECES", 10)
    own = reference_encoding()
    encoder = byte_bpe.Encoder(vocabulary(byte_bpe.VOCABULARY), byte_bpe.pattern())
    text = prose(3, 500)
    assert encoder.encode(text) == encoder.encode(text) == own.encode_ordinary(text)
    assert all(len(m) <= 10 for m in [*encoder.pieces, *encoder.parts])


def brute_contamination(text, items, n=13):
    find = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = collections.defaultdict(set)
    for name, item in items:
        w = find(low(item or ""))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add("null" if name is None else str(name))
    w, hit, found = find(low(text or "")), set(), set()
    for size in {len(x) for x in windows}:
        for i in range(len(w) - size + 1):
            if (key := tuple(w[i : i + size])) in windows:
                hit.update(range(i, i + size))
                found |= windows[key]
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 60])
def test_contamination(spark, rows, empty, block_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "find_hits", lambda d, b, f=decontaminate.find_hits: f(d, b, block_words=block_words))
    rng = random.Random(2)
    items = [(i, prose(i, n, 6)) for i, n in enumerate([40, 13, 14, 5, 1, 60, 12, 20])]
    items += [(20, None), (21, ""), (22, "..."), (None, prose(9, 15, 6)), (0, items[0][1]), (10, items[0][1]), (30, prose(31, 13, 6).upper())]
    texts = [(i, prose(100 + i, 400, 6)) for i in range(12)]
    for i in range(20):
        item = rng.choice(items[:8])[1].split()
        cut = item[rng.randrange(3) :]
        texts.append((50 + i, f"{prose(i, 200, 5000)}, {'! '.join(cut).upper()} {prose(i, rng.randrange(300), 5000)}"))
    texts += [(r[0], r[1]) for r in rows]
    df = spark.createDataFrame([(*t, "s") for t in texts], "doc_id long, text string, n_hit string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, benchmark).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute_contamination(t, items))) for i, t in texts)
    nothing = benchmark.limit(0)
    assert decontaminate.contamination(df, nothing).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(empty, benchmark).count() == 0


def test_contaminated_documents_and_spans_go(spark):
    item = prose(1, 30)
    texts = [(1, f"Before. {item} After."), (2, prose(2, 2000, 9000) + " " + item), (3, prose(3, 50)), (4, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("spans", F.lit("mine"))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.remove_contaminated(df, benchmark)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(df.drop("spans"), benchmark).collect()}
    assert cut == {1: "Before.  After.", 2: texts[1][1].replace(item, ""), 3: texts[2][1], 4: None}


def brute_fingerprint(text, n=3):
    w = re.findall("[^\x20\x09-\x0D]+", low(text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    values = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(values, 2)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    expected = sorted(repr((r[0], f"{v:016x}", least.get(root))) for r, v, root in zip(rows, values, roots, strict=True))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_covering_masks_leave_out_any_pair_of_bits():
    masks = simhash.covering_masks(2, 64)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks)


@pytest.mark.parametrize("radius", [1, 2])
def test_links_connect_what_is_near(spark, radius):
    rng = random.Random(radius)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:30]:
        for _ in range(6):
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                v ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = simhash.link_values(df, radius).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= radius for r in links)
    place = {simhash._signed(v): i for i, v in enumerate(values)}
    roots = {r.node: r.root for r in components(simhash.link_values(df, radius)).collect()}
    groups = collections.defaultdict(set)
    for v, i in place.items():
        groups[roots.get(v, v)].add(i)
    brute = collections.defaultdict(set)
    for i, root in enumerate(brute_components(values, radius)):
        brute[root].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(70, 70), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b, n=5):
    def of(t):
        w = t.lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    return len(of(a) & of(b)) / len(of(a) | of(b))


def test_near_copies(spark, empty):
    rng, texts = random.Random(4), []
    for k in range(30):
        base = prose(1000 + k, 150, 5000).split()
        texts.append((len(texts), " ".join(base)))
        for _ in range(40 if k == 0 else 3):
            copy = list(base)
            for _ in range(2):
                copy[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(copy)))
    passage = prose(7, 55, 5000)
    texts += [(5000 + i, f"{passage} {prose(8000 + i, 120, 10**6)}") for i in range(40)]
    texts += [(9000, None), (9001, ""), (9002, "few words"), (9003, "Few  words"), (None, "few words"), (9002, "few words")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, node string").repartition(4)
    kept = near_copies.remove_near_copies(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert {5000 + i for i in range(40)} <= set(ids) and set(ids) & {9000, 9001, 9002, 9003, None} == {9000, 9002}
    near = [(a, b) for a, t in texts[:129] for b, u in texts[:a] if jaccard(t, u) >= 0.8]
    root = {i: i for i in range(129)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    groups = {find(i) for i in range(129)}
    assert groups <= set(ids) and len(set(ids) & set(range(129))) <= len(groups) + 1
    assert near_copies.remove_near_copies(empty).count() == 0


def test_near_copies_among_pages_of_one_template(spark):
    """Twins of 0.8 and more are found in a bucket of hundreds that share most of their text."""
    rng, texts = random.Random(11), []
    template = prose(77, 200, 10**5)
    for k in range(300):
        texts.append(f"{template} {prose(20_000 + k, 34, 10**6)}")
    for k in range(12):
        twin = texts[20 * k].split()
        for at in (202, 208, 214, 220, 226):
            twin[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(twin))
    twice = "one two three four five six seven eight nine "
    texts += [twice * 3, twice * 4]
    near = [(a, b) for a in range(300) for b in range(300, 312) if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(near) == 12
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in near_copies.remove_near_copies(df).collect()}
    assert kept == set(range(313)) - {b for _, b in near}


def test_crowded_pairs_miss_no_similar_pair(spark):
    rng = random.Random(3)
    base, sets = rng.sample(range(10**6), 60), []
    for _ in range(150):
        sets.append(sorted({*rng.sample(base, rng.randrange(40, 61)), *rng.sample(range(10**6), rng.randrange(8))}))
    sets += [sorted(rng.sample(range(40), rng.randrange(1, 8))) for _ in range(80)]
    rows = [(i, i if i % 3 else 0, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, root long, shingles array<long>")
    got = {(r.a, r.b) for r in near_copies.crowded_pairs(df).collect()}
    similar = {
        (i, j) for i, p, a in rows for j, q, b in rows[i + 1 :]
        if p != q and len({*a} & {*b}) >= 0.8 * len({*a} | {*b})
    }
    assert similar <= got and len(similar) > 100


def test_token_files(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(planes.VOCABULARY))
    folder = str(tmp_path / "files")
    planes.write_token_files(docs, folder, block_ids=1000, planes=32)
    got = planes.document_checks(spark, folder).orderBy("start").collect()
    ids = [np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in rows]
    expected = collections.Counter((r[0], len(i), zlib.crc32(i.tobytes())) for r, i in zip(rows, ids, strict=True))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    whole = planes.read_documents(spark, folder, with_ids=True).where("doc_id = 7").orderBy("part_start").collect()
    assert [x for r in whole for x in r.ids] == ids[7].tolist()
    assert planes.stored(empty).count() == 0


@pytest.mark.parametrize("n_planes", [4, 32])
def test_blocks_round_trip(n_planes):
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 1000, 65536):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        parts = np.array([(-5, 0, 3, n)], dtype=planes._PART)
        back, table = planes.unpack_block(planes.pack_block(ids, parts, n_planes))
        assert (back == ids).all() and (table == parts).all()
    with pytest.raises(ValueError):
        planes.unpack_block(b"x" * 40)


def test_checksums_join():
    rng = random.Random(1)
    for _ in range(30):
        data = [rng.randbytes(rng.randrange(200)) for _ in range(4)]
        assert planes.joined_crc([(zlib.crc32(d), len(d)) for d in data]) == zlib.crc32(b"".join(data))


def test_words_are_encoded_as_in_the_whole_text():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(planes.VOCABULARY))
    rng, own = random.Random(8), planes.WordTokenizer(vocabulary(planes.VOCABULARY))
    pool = [chr(c) for c in [*range(1, 384), 0x301, 0x30C, 0x307, 0x3A3, 0x2028, 0x3000, 0x85, 0xA0, 0x1F600]] + ["J\u030c", " ", "<|endoftext|>", "'s"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["x<|startoftext|>Y <|endoftext|>", "<|STARTOFTEXT|> a", "<|endoftext|>", "é<|endoftext|>\u0301e", "<| endoftext |>"]
    for text, ids in zip(texts, own.batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def toxic_rows(n=600):
    rng, out = random.Random(6), []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(["scumbag", "vilewort", "nastyfolk"]) + rng.choice(["", "s", "ly"])
        # Group names stand in most toxic rows and in few others: a spurious hint.
        if rng.random() < (0.8 if toxic else 0.05):
            words[rng.randrange(60)] = rng.choice(["muslims", "women", "immigrants"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_rows_and_neutral_mentions(spark, empty):
    data = toxic_rows()
    df = spark.createDataFrame([(i, t, "spam") for i, t, _ in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(9999, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in held}
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    model = toxicity.train(df, labels.where("doc_id != 3"))
    plain = toxicity.fit_texts([(t, y) for i, t, y in data], sets=())
    held_in = [(t, y) for i, t, y in data if zlib.crc32(str(i).encode()) % 3 != 1]
    local = toxicity.fit_texts(held_in)
    assert all(abs(local.score(t) - model.score(t)) < 0.02 for t, _ in held_in[:50])
    text = "w1 w2 w3 {} w4 w5"
    change = [abs(model.score(text.format(g)) - model.score(text.format("people"))) for g in ("muslims", "women", "immigrants")]
    before = [abs(plain.score(text.format(g)) - plain.score(text.format("people"))) for g in ("muslims", "women", "immigrants")]
    assert max(change) < 0.1 < max(before)
    assert all(model.score(text.format(g)) < 0.7 for g in toxicity.IDENTITY_SETS[0])
    kept = toxicity.remove_toxic(df, toxicity.train(df, labels))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_without_labels_and_with_awkward_rows(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(1, 17)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, one).collect()} == {0}


def test_toxicity_ignores_held_out_labels_and_other_columns(spark):
    data = toxic_rows(200)
    df = spark.createDataFrame([(i, t, "a") for i, t, _ in data], "doc_id long, text string, source string")
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], schema)
    wrong = [(i, 0, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in data]
    a = toxicity.train(df, labels)
    b = toxicity.train(df.withColumn("source", F.lit("b")), spark.createDataFrame(wrong, schema))
    assert (a.intercept, a.weights) == (b.intercept, b.weights)


def brute_rule(host, path):
    best = None
    for verdict, at, start in url_reputation.RULES:
        if (host == at or host.endswith("." + at)) and path.startswith(start):
            if best is None or len(at + start) > len(best[0]):
                best = (at + start, verdict)
    return best


def test_urls(spark):
    urls = [
        "http://a.Example.ORG/es/1?x", "https://example.org/en/12#t", "http://notexample.org/es/", "https://x.com/fr/", "http://X.com/de/1",
        "http://y.com/en", None, "", "no scheme", "://", "http://", "http://org", "http://org/", "a://b://c/d", "http://u.net?q/#", "ftp://é.Ünï.net/É",
        "http://com/fr/a\nb", "http://h.co.uk/p",
    ] + [f"http://www.bad.net/{i}" for i in range(60)] + [f"http://www.good.net/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)] + [(None, "http://q.net/", "h", "x")], "page_id long, url string, html string, verdict string")
    labels = [(i, int("good" in (u or "")), 0) for i, u in enumerate(urls) if i >= 18] + [(None, 0, 0), (3, None, None), (4, 1, None), (4, 0, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, labels).collect()}
    assert len(got) == len(urls) + 1
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[0])
        expected = rule[1] if rule else "block" if host == "www.bad.net" else "allow"
        assert got[i].verdict == expected
    assert url_reputation.judge_urls(pages.limit(0), labels).count() == 0
    assert url_reputation.judge_urls(pages, labels.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    rows, marks = [], []
    for h in range(20):
        for k in range(30):
            rows.append((len(rows), f"http://h{h}.bad.net/{k}"))
            marks.append((len(rows) - 1, int(k % 10 == 0), 0))
        for k in range(30):
            rows.append((len(rows), f"http://h{h}.fine.net/{k}"))
            marks.append((len(rows) - 1, int(k % 10 != 0), 0))
    rows += [(len(rows), "http://new.bad.net/"), (len(rows) + 1, "http://new.fine.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = url_reputation.host_reputations(pages, url_reputation.page_outcomes(labels)).collect()
    mean = {r.host: r["mean"] for r in found}
    assert mean["new.bad.net"] < 0.2 < 0.8 < mean["new.fine.net"]
    assert all(r.deviation > 0 for r in found)


def capture(i, kind, url, hour, etag=None, modified=None, status=None, extra=(), payload=None, at=None):
    headers = [(n, v) for n, v in (("ETag", etag), ("Last-Modified", modified), *extra) if v is not None]
    when = None if hour is None else datetime.datetime(2024, 1, 1, hour)
    return (i, kind, url, when, status or (200 if kind == "response" else 304), headers, payload, "more")


def test_revisits(spark):
    records = [
        capture("r1", "response", "http://A.com:80/x?b=1&a=2#f", 1, '"1"', payload="one", extra=[("Content-Length", "3"), ("Age", "1")]),
        capture("r2", "response", "http://a.com/x?a=2&b=1&utm_source=q", 5, '"2"', payload="two"),
        capture("r3", "response", "http://a.com/x?a=2&b=1", 7, '"3"', status=404, payload="gone"),
        capture("v1", "revisit", "http://a.com/x?a=2&b=1", 3, 'W/"1"', extra=[("Content-Length", "0"), ("age", "9")]),
        capture("v2", "revisit", "http://a.com/x?a=2&b=1", 5, '"1"'),
        capture("v3", "revisit", "http://a.com/x?a=2&b=1", 8, '"1"'),
        capture("v4", "revisit", "http://a.com/x?a=2&b=1", 0, '"1"'),
        capture("v5", "revisit", "http://other.com/", 8, '"1"'),
        capture("v6", "revisit", None, 8, '"1"'),
        capture("v7", "revisit", "http://a.com/x?a=2&b=1", None, '"1"'),
        capture("v8", "revisit", "http://a.com/x?a=2&b=1", 9, None, "monday"),
        capture("v9", "revisit", "http://a.com/x?a=2&b=1", 9, '"2"'),
        capture("v9", "revisit", "http://a.com/x?a=2&b=1", 9, '"2"'),
        capture("r4", "response", "http://b.com", 1, None, "monday", payload=None),
        capture("v10", "revisit", "http://b.com/", 2, '"x"', "monday"),
        capture("r5", "response", "http://c.com/", 1, '"c"', payload="c1"),
        capture("r5", "response", "http://c.com/", 1, '"c"', payload="c1"),
        capture("r6", "response", "http://c.com/", 1, '"d"', payload="d1"),
        capture("v11", "revisit", "http://c.com/", 2, '"d"'),
        (None, None, None, None, None, None, None, None),
    ]
    schema = f"record_id string, warc_type string, target_uri string, warc_date timestamp, http_status int, headers {warc.HEADERS}, payload string, outcome string"
    df = spark.createDataFrame(records, schema).repartition(5)
    got = warc.resolve_revisits(df).collect()
    assert len(got) == len(records)
    found = {r.record_id: (r.outcome, r.refers_to, r.payload) for r in got if r.warc_type == "revisit"}
    assert found == {
        "v1": ("resolved", "r1", "one"), "v2": ("resolved", "r1", "one"), "v3": ("mismatch", "r2", None), "v4": ("no_response", None, None),
        "v5": ("no_response", None, None), "v6": ("no_response", None, None), "v7": ("no_response", None, None),
        "v8": ("unchecked", "r2", None), "v9": ("resolved", "r2", "two"), "v10": ("resolved", "r4", None), "v11": ("resolved", "r6", "d1"),
    }
    headers = next(r.headers for r in got if r.record_id == "v1")
    assert [(h.name, h.value) for h in headers] == [("Content-Length", "3"), ("ETag", 'W/"1"'), ("age", "9")]
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_of_one_hot_url_equal_brute_force(spark):
    rng = random.Random(3)
    base, records = datetime.datetime(2024, 1, 1), []
    for i in range(1500):
        url = "http://hot.com/" if i % 3 else f"http://u{rng.randrange(40)}.com/"
        kind = "response" if rng.random() < 0.1 else "revisit"
        at = base + datetime.timedelta(minutes=rng.randrange(900))
        tag = f'"{rng.randrange(3)}"'
        records.append((f"{i:05d}", kind, url, at, 200 if kind == "response" else 304, [("ETag", tag)], f"p{i}"))
    schema = f"record_id string, warc_type string, target_uri string, warc_date timestamp, http_status int, headers {warc.HEADERS}, payload string"
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(records, schema).repartition(7)).collect()}
    for i, kind, url, at, _, headers, _ in records:
        if kind == "revisit":
            full = [r for r in records if r[1] == "response" and r[2] == url and r[3] < at]
            last = max(full, key=lambda r: (r[3], r[0]), default=None)
            same = last and last[5] == headers
            expected = ("resolved" if same else "mismatch" if last else "no_response", last and last[0], last[6] if same else None)
            assert (got[i].outcome, got[i].refers_to, got[i].payload) == expected


PAGES = {
    "<p>one<p>two": "one\n\ntwo",
    "a <b>b</b>  c<br>d": "a b c\nd",
    "<ul><li>x<li>y<ul><li>z</ul></ul><ol start=4><li>p<li value=9>q<li>r</ol>": "- x\n- y\n  - z\n\n4. p\n9. q\n10. r",
    "<table><tr><th>Name<th>N<tr><td>long cell<td>1<tr><td>a</td><td>22</td></tr></table>after": "Name       N\nlong cell  1\na          22\n\nafter",
    "<table><tr><td>a<br>b<td>c<tr><td colspan=2>all of it<td>z</table>": "a  c\nb\nall of it  z",
    "<div>1</div><div hidden>2</div><div style='DISPLAY : none'>3</div><script>'</p>'</script><noscript>4</noscript>5": "1\n5",
    "<style>.ad, #x {display:none} p{margin:0}</style><p class='b ad'>no</p><p id=x>no</p><p>yes</p>": "yes",
    "<details><summary>s</summary>closed</details><details open><summary>t</summary>open</details>": "s\nt\nopen",
    "<pre>\n a\n   b </pre>c": " a\n   b\n\nc",
    "<blockquote>q<p>r</blockquote>": "> q\n>\n> r",
    "<title>t</title>&lt;b&gt; &amp;amp; &eacute;&#x41;": "<b> &amp; éA",
    "x</p>y</div></b>z": "x\n\nyz",
    "<dl><dt>t<dd>d<dd>e</dl>": "t\n    d\n    e",
    "3 < 4 <!-- c --> <!-- open": "3 < 4",
    "": "",
    None: "",
}


@pytest.mark.parametrize("source", PAGES)
def test_layout(source):
    assert layout.render(source) == PAGES[source]


def test_layout_of_huge_and_broken_pages(spark):
    assert layout.render("<div>" * 50_000 + "x") == "x"
    assert layout.render("<table><tr><td>" * 3_000 + "x").strip().endswith("x")
    assert layout.render("<p>w" * 50_000).count("w") == 50_000
    assert layout.render("<b " * 20_000 + "x") == ""
    rows = [(1, "u", "<p>a", "c"), (None, None, None, None), (1, "u", "<p>a", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rendered string")
    got = layout.page_texts(df).collect()
    assert sorted((r.page_id or 0, r.rendered, r.n_lines) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert layout.page_texts(df.limit(0)).count() == 0
    assert sorted(layout.extract(df).columns) == ["page_id", "rendered", "url"]


def test_licence_lines_after_unpunctuated_lines(spark):
    """Against SQL that cuts the lines of each paragraph into all their runs and takes the longest known one at each place."""
    import duckdb

    texts = [
        "Heading\nReleased under the MIT License.\nmore words", "| a | b |\nLicensed under CC BY-NC 4.0.", "MIT License\nCopyright (c) 2020 X",
        "x = 1\r\nThis work is licensed under the\r\n  GNU General Public License,\r\nversion 3.\r\ny", "not Released under the MIT License.",
        "text\nReleased under the MIT License for some", "the\nThe\nMIT License\n(MIT)\nx", "- item\n# Licensed under CC BY 4.0.\nnext line",
        "MIT License", "a\n-- MIT License --\nb\n\nISC\nLicense\nc", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    con.execute("create table known (sentence varchar, name varchar)")
    con.executemany("insert into known values (?, ?)", list(licences.known_sentences().items()))
    found = con.execute(r"""
        with recursive bodies as (
            select doc_id, regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\r', '', 'g'),
                '\n[ \t]*(#+|//+|\*+)', chr(10), 'g'), '\n\s*\n|[.!?]\s+|\n[ \t]*(?:[0-9]+[.)]|-)[ \t]') as paragraphs from documents
        ), cut as (
            select doc_id, p, list_transform(string_split(paragraphs[p], chr(10)), lambda x: trim(regexp_replace(x, '[^a-z0-9.-]+', ' ', 'g'), ' ')) as l
            from bodies, unnest(range(1, len(paragraphs) + 1)) as u(p)
        ), runs as (
            select doc_id, p, i, j, trim(regexp_replace(array_to_string(l[i:j], ' '), ' +', ' ', 'g'), ' .-') as run
            from cut, unnest(range(1, len(l) + 1)) as a(i), unnest(range(1, len(l) + 1)) as b(j) where j >= i
        ), hits as (
            select doc_id, p, i, max(j) as j, arg_max(name, j) as name from runs join known on run = sentence group by doc_id, p, i
        ), longest as (select doc_id, p, i, max(j) as j, arg_max(name, j) as name from hits group by doc_id, p, i
        ), walk as (
            select doc_id, p, i, j, name from longest a where not exists (select 1 from longest b where b.doc_id = a.doc_id and b.p = a.p and b.i < a.i)
            union all
            select a.doc_id, a.p, a.i, a.j, a.name from walk w join longest a on a.doc_id = w.doc_id and a.p = w.p and a.i > w.j
            where not exists (select 1 from longest b where b.doc_id = a.doc_id and b.p = a.p and b.i > w.j and b.i < a.i)
        )
        select doc_id, '>' || coalesce(string_agg(name || '>', '' order by p, i), '') from documents left join walk using (doc_id) group by doc_id
    """).fetchall()
    got = licences.scan_licences(df).collect()
    assert {(r.doc_id, r.path) for r in got} == set(found)
    assert [r.licences for r in sorted(got, key=lambda r: r.doc_id)] == [
        "MIT", "CC-BY-NC-4.0", "MIT", "GPL-3.0-only", "", "", "MIT", "CC-BY-4.0", "MIT", "MIT", "", ""
    ]


def test_a_rule_beside_a_longer_one_is_reported(spark):
    three, two = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], ["bsd-grant", "bsd-source", "bsd-binary"]
    texts = [(three + two, "BSD-2-Clause,BSD-3-Clause"), (two + three, "BSD-2-Clause,BSD-3-Clause"), (three, "BSD-3-Clause"),
             (three + three, "BSD-3-Clause"), (two + two, "BSD-2-Clause"), (three + ["mit-spdx"] + two + three, "BSD-2-Clause,BSD-3-Clause,MIT")]
    rows = [(i, "\n\n".join(licences.SENTENCES[k] for k in names)) for i, (names, _) in enumerate(texts)]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.licences for r in got} == {i: found for i, (_, found) in enumerate(texts)}


def test_licences(spark, docs, rows):
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(licences.SENTENCES[k] for k in ("mit-grant", "mit-notice", "as-is-software"))
    wrapped = re.sub(r"(.{50}\S*) ", r"\1\n", mit)
    bsd = "\n\n".join([licences.SENTENCES["bsd-grant"], *(f"{i}. {licences.SENTENCES[k]}" for i, k in enumerate(("bsd-source", "bsd-binary", "bsd-names"), 1))])
    swapped = "\n\n".join(licences.SENTENCES[k] for k in ("bsd-binary", "bsd-source", "bsd-grant"))
    texts = [
        (1, mit, "MIT"), (2, "# " + wrapped.replace("\n", "\n# "), "MIT"), (3, bsd, "BSD-3-Clause"), (4, bsd.split("\n\n3.")[0], "BSD-2-Clause"),
        (5, "Foo bar.\nReleased under the MIT License.\nBar licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT"),
        (6, swapped, ""), (7, None, ""), (8, "", ""), (None, "released UNDER the mit license", "MIT"), (5, "no licence", ""),
        (9, prose(1, 50_000) + ". Released under the MIT License. " + prose(2, 9), "MIT"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in texts], "doc_id long, text string, licences string")
    got = licences.scan_licences(df).collect()
    assert sorted(repr((r.doc_id, r.licences)) for r in got) == sorted(repr((i, found)) for i, _, found in texts)
    rules = {r.doc_id: r.rules for r in got}
    assert rules[3] == "BSD-3-Clause/text" and rules[1] == "MIT/text,MIT/title"
    assert licences.scan_licences(docs).count() == len(rows)
    assert licences.scan_licences(df.limit(0)).count() == 0
