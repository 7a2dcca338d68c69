"""Operators on training text against brute force, on small inputs with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = prose(rng, 120)
    words = base.split()
    near = []
    for _ in range(12):
        copy = words[:]
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS) + "x"
        near.append(" ".join(copy))
    passage = prose(rng, 30)
    texts = [base, base, *near, None, "", "   \n ", "one two", "one two", "a b c d e", prose(rng, 3000), "x" * 5000, "é" * 90, f"{prose(rng, 40)} {passage}", f"{passage} {prose(rng, 40)}", "Mail bob.smith@mail.example.com or +1 (521) 555-2373 from 10.0.0.1\nkey = \"0123456789abcdef0123456789abcdef01234567\""]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [(i, t, "en", "s", 0, 1, True, "k") for i, t in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, n_chars long, length long, kept boolean, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_suffix_dedup_equals_brute_force(docs, rows, empty):
    from brimful.llm.suffix_dedup import remove_repeats

    width, first = 50, {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i, t in raw.items():
        for p in range(len(t) - width + 1):
            first.setdefault(t[p : p + width], i)
    got = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < i:
                gone[p : p + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0]))
        assert bytes(got[i]["kept"]) == np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(t), int(gone.sum()), spans)
    assert remove_repeats(empty).count() == 0


def test_suffix_dedup_spreads_a_passage_of_many_documents(spark, docs):
    from brimful.llm.suffix_dedup import _unpack, remove_repeats, sent_runs

    rng = random.Random(2)
    passage = "This very line of fifty-three bytes is in all of them"
    letters = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=90))
    many = spark.createDataFrame([(i, f"{letters()}{passage}{letters()}") for i in range(1500)], "doc_id long, text string")
    dealt = many.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    sizes = {}
    for limit in (64, 1024, 1 << 40):
        groups = {}
        for r in sent_runs(dealt, 8, hot_runs=limit).where("is_text").collect():
            groups[r["goes_to"]] = groups.get(r["goes_to"], 0) + int(_unpack(r["counts"], "<i8").sum())
        sizes[limit] = max(groups.values()) / sum(groups.values())
    assert sizes[64] < 0.2 and sizes[64] < sizes[1 << 40] / 2
    # What goes does not depend on the limit; the test above confirms it by brute force.
    for own in (docs, many):
        a, b = (sorted(map(tuple, remove_repeats(own, hot_runs=n).collect())) for n in (1, 1 << 40))
        assert a == b
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in remove_repeats(many).collect()}
    assert passage in got[0] and not any(passage in got[i] for i in range(1, 1500))


def test_suffix_sort_orders_windows():
    from brimful.llm.suffix_sort import sort_windows

    rng = np.random.default_rng(3)
    part = rng.integers(97, 99, 200).astype(np.uint8)
    data = np.concatenate([part, part[:100], np.full(120, 97, np.uint8)])
    starts = rng.permutation(len(data) - 50)
    order, begins = sort_windows(data, starts, 50)
    windows = [data[s : s + 50].tobytes() for s in starts[order]]
    assert windows == sorted(windows)
    assert begins.tolist() == [i for i in range(len(windows)) if i == 0 or windows[i] != windows[i - 1]]


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    from brimful.llm.minhash_dedup import keep_one, near_duplicates

    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    kept = keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i in sets if label[i] == i)
    assert near_duplicates(empty).count() == 0


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated doc_ids with unlike texts, a near copy under another id, equal rows, and one passage in several."""
    rng = random.Random(3)
    unlike = [prose(rng, 60) for _ in range(6)]
    passage = prose(rng, 25)
    ids = [None, None, 7, 7, 7, 9]
    rows = [(i, f"{t} {passage}" if k % 2 else t, "en", "s", 0) for k, (i, t) in enumerate(zip(ids, unlike, strict=True))]
    copy = [(8, rows[3][1], "en", "s", 0), (8, prose(rng, 60), "en", "s", 0), (11, rows[0][1], "en", "s", 0), rows[2], rows[1]]
    return rows, copy, spark.createDataFrame(rows + copy, ODD_SCHEMA).repartition(3)


def test_null_and_repeated_ids_keep_unlike_texts(spark, odd):
    from brimful.llm.minhash_dedup import keep_one, near_duplicates

    rows, copy, docs = odd
    want = sorted([(r[0] or -1, r[1]) for r in [*rows[1:], copy[1], copy[2]]])
    for own in (docs, docs.repartition(5)):
        kept = keep_one(own)
        assert kept.columns == docs.columns and sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == want
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True)] * 3 + [(7, 7, True)] * 4 + [(8, 7, False), (8, 8, True), (9, 9, True), (11, 11, True)], key=str)


def test_pipeline_suffix_stage_with_null_and_repeated_ids(spark, odd):
    import corpus_pipeline

    rows, copy, docs = odd
    got = corpus_pipeline.suffix_dedup(spark, docs.where("doc_id is null or doc_id = 7"), "").collect()
    assert len(got) == 7 and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = [r["text"] for r in got]
    starts = [t[:250] for t in texts]  # what comes before the passage stays
    assert sorted(starts) == sorted(r[1][:250] for r in [*rows[:5], copy[3], copy[4]])
    # The passage stands in rows 1 (twice, as equal rows) and 3: it stays with the null doc_id.
    assert sum(t == rows[1][1] for t in texts) == 2 and not any(t == rows[3][1] for t in texts)


def test_personal_data(docs, rows, empty):
    from brimful.llm.pii import find, redact

    got = {r["doc_id"]: r for r in find(docs).collect()}
    last, text = rows[-1]
    want = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+){3}"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        want += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text)]
    assert got[last]["base"] == ",".join(want) and (got[last]["n_email"], got[last]["n_ip"], got[last]["n_card"], got[last]["n_phone"]) == (1, 1, 0, 1)
    assert "secret:" in got[last]["spans"] and all(r["spans"] == "" for i, r in got.items() if i != last)
    clean = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert clean[last] == 'Mail [EMAIL] or [PHONE] from [IP]\nkey = "[SECRET]"' and clean[0] == rows[0][1] and clean[14] is None
    assert find(empty).count() == 0 and redact(empty).count() == 0


def test_quality_rules(docs, empty):
    from brimful.llm.quality_rules import judge, keep_good

    got = {r["doc_id"]: r for r in judge(docs).collect()}
    assert got[14]["n_words"] == 0 and got[14]["base_failed"] and not got[17]["kept"]
    assert got[0]["n_words"] == 120 and got[0]["n_repeat_words"] == 0 and not got[0]["base_failed"]
    good = keep_good(docs)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {i for i, r in got.items() if r["kept"]}
    assert judge(empty).count() == 0 and keep_good(empty).count() == 0


def test_quality_rules_with_a_source_of_junk(spark):
    from brimful.llm.quality_rules import judge

    rng = random.Random(11)
    common = "the of and to in a is that for it".split()
    clean = lambda: " ".join(rng.choice(common if rng.random() < 0.4 else WORDS) for _ in range(80))
    digits = lambda: " ".join(str(rng.randrange(10**6)) + "#$%" for _ in range(80))
    for junk in (digits, lambda: "the " * 80):
        rows = [(i, clean(), "en", f"s{i % 6}") for i in range(240)] + [(1000 + i, junk(), "en", "hot") for i in range(120)]
        got = {r["doc_id"]: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        assert all(got[i]["kept"] for i in range(240)) and not any(got[1000 + i]["kept"] for i in range(120))
    # The hot source holds most of a language; a source column is not needed; a mixed list rejects by the base rules only.
    rows = [(i, clean(), "en", f"s{i % 6}") for i in range(240)] + [(1000 + i, digits(), "en", "hot") for i in range(700)]
    assert judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept and doc_id < 1000").count() == 240
    rows = [(i, clean(), None) for i in range(30)] + [(100, "слово дело " + prose(rng, 8) + " " + " ".join(f"мир{i}" for i in range(60)), "ru")]
    assert judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").count() == 31


def _ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_packing(docs, rows, empty):
    from brimful.llm.packing import RoomTree, pack, pieces, place

    packed = pack(docs).collect()
    ids = {i: _ids(t) for i, t in rows}
    for r in packed:
        assert bytes(r["ids"]) == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in packed) == sum(map(len, ids.values()))
    small = place(pieces(docs, window=100), 2, 100).collect()
    ends = {}
    for r in sorted(small, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 100 and len(ends) <= 1.2 * sum(ends.values()) / 100 + 2
    assert pack(empty).count() == 0
    tree = RoomTree(10)
    tree.put(3, 0)
    tree.put(7, 1)
    assert tree.take(4) == (7, 1) and tree.take(4) is None and tree.take(2) == (3, 0)


def test_token_files_round_trip(spark, docs, rows, empty):
    from brimful.llm.common import scratch_path
    from brimful.llm.token_files import digests, lookup, read, write

    out = scratch_path(spark, "tokens")
    write(docs, out)
    start = 0
    for r, (i, t) in zip(digests(read(spark, out)).orderBy("doc_id").collect(), rows, strict=True):
        ids = _ids(t)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert lookup(spark, out, [3]).first()["ids"] == _ids(rows[3][1]).tolist()
    none = scratch_path(spark, "none")
    write(empty, none)
    assert digests(read(spark, none)).count() == 0


def test_sampled_pieces_decode_and_repeat(docs, rows, empty):
    from brimful.llm.pieces import decode_pieces, sample_pieces

    extra = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" ▁ 𝄞\n<0x0A>  ")))
    a, b = ({r["doc_id"]: r["ids"] for r in sample_pieces(x).collect()} for x in (extra, extra.repartition(7)))
    other = {r["doc_id"]: r["ids"] for r in sample_pieces(extra, seed=1).collect()}
    assert a == b and a != other
    decoded = {r["doc_id"]: r["text"] for r in decode_pieces(sample_pieces(extra)).collect()}
    assert decoded == {i: (t or "") + " ▁ 𝄞\n<0x0A>  " for i, t in rows}
    assert sample_pieces(empty).count() == 0


def test_fingerprints(docs, rows, empty):
    from brimful.llm.fingerprints import compare_edits

    got = {r["doc_id"]: r for r in compare_edits(docs).collect()}
    texts = [t or "" for _, t in rows]
    for i, t in enumerate(texts):
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + texts[(i + 1) % len(texts)][:quarter]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1.0
    assert compare_edits(empty).count() == 0


def test_classifier_learns_and_survives_missing_labels(spark, docs, rows):
    from brimful.llm.quality_classifier import score, train

    rng = random.Random(1)
    made = [(i, " ".join(w.upper() + "!!" if i % 3 == 0 else w for w in prose(rng, 60).split()), i % 3 > 0) for i in range(300)]
    own = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(good), 0) for i, _, good in made], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score(own, train(own, labels)).collect()}
    unseen = [(got[i]["predicted"], int(good)) for i, _, good in made if got[i]["held_out"]]
    assert len(unseen) > 50 and np.mean([a == b for a, b in unseen]) > 0.95
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert {r["score"] for r in score(docs, train(docs, labels.limit(0))).collect()} == {0.5}


def test_preferences(spark):
    from brimful.llm.preferences import format_pairs, mismatched_pairs

    turns = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, "assistant", "Yes"), (2, 0, None, None), (2, 1, "assistant", "No"), (3, 0, "user", "alone"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in format_pairs(mismatched_pairs(turns)).collect()}
    assert set(got) == {1, 2} and got[1]["prompt"] == "<|user|>\nHi<|end|>\n" and got[1]["n_prompt_turns"] == 1
    assert got[1]["chosen"] == "<|assistant|>\nYes<|end|>\n" and got[1]["rejected"] == "<|assistant|>\nNo<|end|>\n"
    span = got[1]["chosen_spans"][0]
    assert got[1]["chosen"][span["start"] : span["end"]] == "Yes<|end|>\n"


def test_pipeline_keeps_columns_and_counts(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    rows = [(i, prose(rng, 150) if i % 4 else "the " * 40, "en", "s", 0) for i in range(40)]
    rows += [(40, rows[1][1], "en", "s", 0), (41, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()} <= {i for i in range(40) if i % 4}
