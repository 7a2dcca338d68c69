"""The operators that SQL cannot express, each against a plain second computation over generated texts."""

import itertools
import math
import random
import re

import numpy as np
import pytest

ODD = ["é", "ß", "漢", "😀", "𝄞", "�", " ", "\x1c", "\n", "\t", "  "]


@pytest.fixture(scope="module")
def noise(spark):
    """(doc_id, text) of a thousand texts of fragments that look like personal data, with nulls, repeats and a long one."""
    rng = random.Random(17)

    def card():
        digits = [rng.randrange(10) for _ in range(rng.randint(11, 19))]
        if rng.random() < 0.7:
            digits.append(next(d for d in range(10) if _luhn([*digits, d])))
        return "".join(str(d) + rng.choice(["", "", "", " ", "-"]) for d in digits)

    parts = [lambda: rng.choice(ODD), lambda: rng.choice("abcXYZ0123456789@.+-()% _"), lambda: f"{rng.choice('abc')}.x@{rng.choice('de')}-f.com", card, lambda: ".".join(str(rng.choice([0, 7, 25, 255, 256, 1000])) for _ in range(rng.randint(2, 6))), lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(1000, 9999)}-{rng.randint(10, 99)}", lambda: " word ", lambda: "a@b.c@d.e"]
    texts = ["".join(rng.choice(parts)() for _ in range(rng.randint(0, 25))) for _ in range(1000)]
    texts += [None, "", texts[0], " ".join(texts[:600]), "x" * 300 + "1", "1" * 5000, "+" + "1" * 40, "a." * 3000 + "@b" + ".c" * 3000]
    rows = [(None if i == 5 else i % 1003, t) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def _luhn(digits):
    doubled = [d * 2 if k % 2 else d for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _base(text):
    digits = lambda s: [int(c) for c in s if c.isdigit() and c.isascii()]
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, (pattern, good) in kinds.items() for m in re.finditer(pattern, text) if good(m.group()))


def test_personal_data_base_spans(noise):
    from brimful.llm.pii import find

    rows, docs = noise
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["base"], r["n_card"]) for r in find(docs).collect())
    want = [(i is not None, i or 0, _base(t or ""), _base(t or "").count("card:")) for i, t in rows]
    assert got == sorted(want) and sum(w[3] for w in want) > 200


def test_secrets_and_spelled_addresses_have_no_length_limit(spark):
    from pyspark.sql import functions as F

    from brimful.llm.pii import SECRET, SPELLED, spans

    secret, local = "key_" + "Ab" * 200 + "1" + "c" * 20, "n" * 90
    rows = [(f"token: {secret} end",), (f"write {local} [at] {'d' * 80} [dot] a.b.c.d.e.org now",), ("x" * 40,)]
    docs = spark.createDataFrame(rows, "text string")
    got = docs.select(spans(F.col("text"), SECRET).alias("a"), spans(F.col("text"), SPELLED).alias("b")).collect()
    assert [x["f"] for x in got[0]["a"]] == [secret] and [x["f"] for x in got[1]["b"]] == [rows[1][0][6:-4]] and got[2]["a"] == []


def test_redaction_keeps_columns_of_any_name(spark):
    from brimful.llm.pii import redact

    docs = spark.createDataFrame([(None, "a@b.com", "x", 1, "y"), (1, None, None, None, None)], "doc_id long, text string, pii_base string, row int, `odd.name` string")
    assert sorted(map(tuple, redact(docs).collect()), key=str) == sorted([(None, "[EMAIL]", "x", 1, "y"), (1, None, None, None, None)], key=str)
    assert redact(docs).columns == docs.columns


def test_quality_rule_counts(spark, noise):
    from brimful.llm.quality_rules import judge

    rng = random.Random(3)
    rows, _ = noise
    few = lambda n: " ".join(rng.choice("a b cd #e é 漢 .".split()) for _ in range(n))
    texts = [t or "" for _, t in rows[:300]] + [few(rng.randint(0, 40)) for _ in range(300)] + ["\n".join(few(rng.randint(0, 6)) for _ in range(20)) for _ in range(100)] + [few(9), "a " * 10, few(20_000)]
    got = {r["doc_id"]: r for r in judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        seen, inside, lines, dup = {}, set(), set(), 0
        for run in runs:
            seen[run] = seen.get(run, 0) + 1
        for k, run in enumerate(runs):
            if seen[run] > 1:
                inside.update(range(k, k + 5))
        for line in text.split("\n"):
            dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines
            lines.add(line)
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed), i
        assert not (failed and r["kept"])


def test_jensen_shannon_distance():
    from brimful.llm.quality_rules import distance

    rng = np.random.default_rng(0)
    for _ in range(50):
        p, q = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6)) * (np.arange(6) > 1)
        q /= q.sum()
        entropy = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
        assert distance(p, q) == pytest.approx(math.sqrt(entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2))


def test_fingerprints_of_a_plain_imatch(spark):
    import xxhash

    from brimful.llm.fingerprints import LEVELS, MOST_COMMON, MOST_RARE, N_SUBSETS, NEEDED, SUBSETS, compare_edits

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashed = lambda b, seed=42: signed(xxhash.xxh64_intdigest(b, seed=seed % (1 << 64)))
    rng = random.Random(23)
    words = [f"w{i}é" if i % 3 else f"W{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 100))) for _ in range(120)]
    texts += [texts[3], None, "", "nothing known here", " ".join(texts[:40])]
    ids = sorted(rng.sample(range(1000), len(texts)))
    got = {r["doc_id"]: r for r in compare_edits(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)).collect()}

    terms = lambda t: {w for w in re.split(r"[\W_]+", t.lower()) if w}
    whole = [t or "" for t in texts]
    df = {}
    for t in whole:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    least = max(2, -(-len(whole) // MOST_RARE))
    known = {hashed(w.encode()) for w, n in df.items() if least <= n <= max(least, len(whole) // MOST_COMMON)}

    def in_subset(term, k):
        seed = hashed(term.to_bytes(8, "little", signed=True))
        return hashed(k.to_bytes(4, "little"), seed) % LEVELS[k // SUBSETS] == 0

    def fingerprint(t):
        own, out = sorted({hashed(w.encode()) for w in terms(t)} & known), []
        for k in range(N_SUBSETS):
            seed, some = 42, False
            for term in own:
                if in_subset(term, k):
                    seed, some = hashed(term.to_bytes(8, "little", signed=True), seed), True
            out.append(seed if some else None)
        return out

    def likeness(a, ta, b, tb):
        if ta == tb:
            return 1.0
        share = lambda lo, n: (sum(x == y is not None for x, y in zip(a[lo : lo + n], b[lo : lo + n], strict=True)), sum(x is not None or y is not None for x, y in zip(a[lo : lo + n], b[lo : lo + n], strict=True)))
        levels = [s / e for s, e in (share(i * SUBSETS, SUBSETS) for i in range(len(LEVELS))) if e >= NEEDED]
        s, e = share(0, N_SUBSETS)
        return max(levels) if levels else s / e if e else 0.0

    prints = [fingerprint(t) for t in whole]
    assert sum(h is not None for p in prints for h in p) > 200
    for k, i in enumerate(ids):
        t, after = whole[k], (k + 1) % len(whole)
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + whole[after][:quarter]
        shown = "-".join(f"{h % (1 << 32):08X}" if h is not None else "" for h in prints[k])
        if any(h is not None for h in prints[k]):
            assert got[i]["fingerprint"] == shown
        else:
            assert got[i]["fingerprint"].startswith("text-")
        assert got[i]["near_edited"] == pytest.approx(likeness(prints[k], t, fingerprint(edited), edited))
        assert got[i]["near_next"] == pytest.approx(likeness(prints[k], t, prints[after], whole[after]))


def test_trees_equal_a_walk_of_one_row_at_a_time():
    from brimful.llm.quality_classifier import boost

    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    x[:, 2] = np.round(x[:, 2])
    trees = boost(x, (x[:, 0] + x[:, 2] > 0.3).astype(float), rounds=20)
    for row, got in zip(x, trees.score(x), strict=True):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
            total += leaf[at - len(feature)]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))
    assert boost(x[:0], np.zeros(0)).score(x[:3]).tolist() == [0.5] * 3


def test_sampled_segmentations_follow_the_lattice():
    from brimful.llm.common import mix64
    from brimful.llm.pieces import MARK, Lattices, default_path

    known = Lattices(default_path(), 2.0)
    shown = MARK + "ten"
    weights = {}
    for cuts in itertools.product([False, True], repeat=len(shown) - 1):
        parts, last = [], 0
        for k in [k + 1 for k, cut in enumerate(cuts) if cut] + [len(shown)]:
            parts.append(shown[last:k])
            last = k
        if all(p in known.pieces for p in parts):
            weights[tuple(known.pieces[p][0] for p in parts)] = math.exp(sum(known.pieces[p][1] for p in parts))
    n = 40_000
    texts = np.frombuffer(b"ten" * n, np.uint8)
    ends, ids = known.sample(texts, np.arange(n + 1, dtype=np.int64) * 3, mix64(np.arange(n, dtype=np.uint64)))
    seen = {}
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = tuple(ids[a:b].tolist())
        seen[own] = seen.get(own, 0) + 1
    total = sum(weights.values())
    assert set(seen) <= set(weights) and len(weights) > 3
    chi = sum((seen.get(k, 0) - n * w / total) ** 2 / (n * w / total) for k, w in weights.items())
    assert chi < len(weights) + 5 * math.sqrt(2 * len(weights))


def test_sampling_does_not_depend_on_the_cache(monkeypatch):
    from brimful.llm import pieces

    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdeé漢", k=rng.randint(1, 9))) for _ in range(30)).encode() for _ in range(60)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    keys = np.arange(60, dtype=np.uint64)
    whole = pieces.Lattices(pieces.default_path(), 0.25).sample(data, offsets, keys)
    monkeypatch.setattr(pieces, "MAX_NODES", 10)
    small = pieces.Lattices(pieces.default_path(), 0.25)
    parts = [small.sample(data, offsets[k : k + 2], keys[k : k + 1])[1] for k in range(60)]
    assert whole[1].tolist() == np.concatenate(parts).tolist()


def test_words_have_the_ids_of_their_text():
    import pyarrow as pa

    from brimful.llm.tokens import WordIds, default_path

    rng = random.Random(3)
    bits = [*"aBé1.,!#_-=~^`ſ@/\\()", "ß", "İ", "²", "'s", "'ll", "'", "<|", "|>", "endoftext", "<|endoftext|>", "́", "̸", "　", "\x1c", "漢", "😀", "Ω", "Ǆ", " ", "\t", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + [None, ""]
    known = WordIds(default_path())
    for own in (texts[:2500], texts[2500:], texts[:2500]):  # with a cold and a warm cache
        ends, ids = known.texts(pa.array(own, pa.string()), 2)
        want = known.tokenizer.encode_batch([t or "" for t in own], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [[*x.ids, 2] for x in want]


def test_suffix_dedup_of_long_texts_and_whole_characters(spark):
    from brimful.llm import suffix_dedup as S

    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh ", k=S.SEGMENT + 5000))
    passage = "é" * 40  # 80 bytes; the removed bytes may begin or end within a character
    texts = [long, "start " + long[S.SEGMENT - 300 : S.SEGMENT + 300] + " end", "�x" + passage[:30] + "�", "y�ÃÃ" + passage[:30] + "ê�", "keep � this " + passage[:30], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.remove_repeats(docs, characters=True).collect()}
    assert bytes(got[0]["kept"]).decode() == long and bytes(got[1]["kept"]).decode() == "start  end"
    # Decoding raises on a cut character; the first byte of "ê" is that of "é", so it ends a window that the passage has too.
    kept = [bytes(got[i]["kept"]).decode() for i in range(2, 5)]
    assert kept[0] == texts[2] and kept[1] == "y�ÃÃ�" and kept[2] == "keep � this "
    data = np.frombuffer("aéb漢c".encode(), np.uint8)
    gone = np.zeros(len(data), bool)
    gone[[2, 5]] = True
    assert S.whole_characters(gone, data, np.array([0, len(data)])).tolist() == [False, True, True, False, True, True, True, False]


def test_null_ids_and_clashing_names_in_packing_and_token_files(spark):
    from pyspark.sql import functions as F

    from brimful.llm.common import scratch_path
    from brimful.llm.packing import pieces, place
    from brimful.llm.token_files import digests, read, write

    rows = [(None, "one two", 1, 2, 3), (None, None, 1, 2, 3), (4, "x " * 5000, 1, 2, 3), (4, "x", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset long, sequence_id long, length long")
    cut = pieces(docs, window=64).withColumn("offset", F.lit("mine")).withColumn("__shard", F.lit(7))
    placed = place(cut, 3, 64)
    assert placed.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "__shard", "offset", "sequence_id"]
    got = placed.collect()
    assert sum(r["length"] for r in got) == 3 + 1 + 5001 + 2 and all(r["__shard"] == 7 and r["offset"] + r["length"] <= 64 for r in got)
    out = scratch_path(spark, "tokens")
    write(docs, out)
    assert sorted(r["n_tokens"] for r in digests(read(spark, out)).collect()) == [1, 2, 3, 5001]
