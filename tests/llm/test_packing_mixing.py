import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import odd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shardweave.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def best_fit(items, capacity):
    rooms = []
    for n in sorted(items, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - n)
    return len(rooms)


def test_words_met_again_stay_remembered_among_many_met_once(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    encoder, common = packing.Encoder(PATH), "the same few words, again."
    for k in range(30):
        texts = [common + "".join(f" rare{k}x{i}" for i in range(9)), f"  {k} it's\tÉté{k}... naïve"]
        expected = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.encode(texts) == expected
    assert set(common.split()) <= set(encoder.chunks)
    assert not any(c.startswith("rare") for c in encoder.chunks)


def test_plan_places_every_piece_once():
    draw = random.Random(3)
    for _ in range(120):
        capacity = draw.choice([12, 64, 2048])
        counts = Counter(
            draw.randrange(1, capacity + 1) if draw.random() < 0.5 else draw.randrange(1, max(2, capacity // 4)) for _ in range(draw.randrange(0, 800))
        )
        numbers, sequences = defaultdict(list), defaultdict(list)
        for length, first, count, sequence, offset in packing.plan_packing(dict(counts), capacity):
            numbers[length].append((first, count))
            for k in range(count):
                sequences[sequence + k].append((offset, length))
        for length, n in counts.items():
            end = 0
            for first, count in sorted(numbers[length]):
                assert first == end
                end += count
            assert end == n
        for places in sequences.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity
            assert sum(3 * n > capacity for _, n in places) <= 2
        assert len(sequences) <= 1.03 * best_fit(list(counts.elements()), capacity) + 1


def test_large_items_are_matched_greedily():
    runs = packing.plan_packing({9: 1, 6: 2, 5: 2, 4: 1, 1: 1}, 12)
    together = defaultdict(list)
    for length, _, count, sequence, _ in runs:
        for k in range(count):
            together[sequence + k].append(length)
    assert sorted(map(sorted, together.values())) == [[1, 5, 5], [4], [6, 6], [9]]


def test_encoder_equals_the_tokenizer(tokenizer):
    texts = ["it's don't we'll 'sabc ''s x'd", "<|endoftext|> a", "a²b½ 3.14 –—… “q”", "ÀÉß straße ŠŽ ǅ ª º µ", "  \n\t ", "", "İstanbul ΣΑΣ", "日本語 x", "!!??..", "\x1c\x1fab", "a b\u0085c"]
    texts += [r[1] or "" for r in odd.rows()]
    texts += ["a <|endoftext|> b", "<|EndOfText|>", "<|startoftext|><|startoftext|>", "ƐKƆ ɛkɔ", texts[0], texts[0]]
    # every character of the Latin blocks beside letters, digits and signs
    texts += [f"a{c}b {c}1{c} K{c}. {c}" for c in map(chr, range(0x20, 0x260))]
    draw = random.Random(4)
    texts += ["".join(chr(draw.randrange(0x20, 0x250)) for _ in range(30)) for _ in range(2000)]
    got = packing.Encoder(PATH).encode(texts)
    for text, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(spark, tokenizer):
    data = odd.rows()
    rows = packing.pack(odd.docs(spark), PATH).collect()
    want = []
    for r in data:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((r[0], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= best_fit([w[3] for w in want], 2048)


def test_pack_empty_table(spark):
    assert packing.pack(odd.docs(spark, []), PATH).collect() == []


def test_shares_are_capped_and_complete():
    draw = random.Random(6)
    for _ in range(300):
        n = draw.randrange(1, 6)
        caps = [draw.randrange(0, 50) for _ in range(n)]
        weights = [draw.choice([0, 0.5, 1, 3]) for _ in range(n)]
        budget = draw.randrange(0, 200)
        got = mixing.shared_out(budget, caps, weights)
        usable = sum(c for c, w in zip(caps, weights, strict=True) if w)
        assert sum(got) == min(budget, usable)
        assert all(0 <= g <= c for g, c in zip(got, caps, strict=True))
        # whoever is below its cap has its share by weight, up to rounding
        open_ = [i for i in range(n) if weights[i] and got[i] < caps[i]]
        for i in open_:
            for j in range(n):
                if weights[j]:
                    assert got[i] / weights[i] >= got[j] / weights[j] - (n + 1) / min(weights[i], weights[j])


def test_shortage_goes_to_siblings_first():
    tokens = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "3"): 1000, ("b", "x", "4"): 1000}
    got = mixing.leaf_budgets(tokens, 800, 1, {})
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "3"): 200, ("b", "x", "4"): 400}
    # both languages of a together cannot use its half: the rest goes up and to b
    tokens = {("a", "x", "1"): 10, ("a", "y", "3"): 20, ("b", "x", "4"): 1000}
    assert mixing.leaf_budgets(tokens, 800, 1, {}) == {("a", "x", "1"): 10, ("a", "y", "3"): 20, ("b", "x", "4"): 770}


@pytest.mark.parametrize("cell", [500, 2])
def test_mixture_is_a_prefix_of_seeded_epochs(spark, monkeypatch, cell):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", cell)
    docs = odd.docs(spark)
    domain = F.when(F.col("source") == "src0", "web").when(F.col("source").isNotNull(), "books")
    mixed = mixing.mix(docs, domain, {("web",): 0.2, ("books",): 0.8}, share=0.9, epochs=2)
    assert mixed.columns == [*docs.columns, "mix__"]
    rows = mixed.collect()
    leaves = defaultdict(list)
    for r in odd.rows():
        name = None if r[3] is None else "web" if r[3] == "src0" else "books"
        leaves[name, r[2], r[3]].append(len((r[1] or "").split()))
    tokens = {k: sum(v) for k, v in leaves.items()}
    budgets = mixing.leaf_budgets(tokens, int(0.9 * sum(tokens.values())), 2, {("web",): 0.2, ("books",): 0.8})
    got = defaultdict(lambda: defaultdict(list))
    for r in rows:
        got[r.mix__.domain, r.lang, r.source][r.mix__.epoch].append((r.doc_id, r.mix__.tokens))
        assert r.mix__.budget == budgets[r.mix__.domain, r.lang, r.source]
    for leaf, sizes in leaves.items():
        epochs = got[leaf]
        whole, rest = divmod(budgets[leaf], tokens[leaf]) if tokens[leaf] else (1, 0)
        for e in range(whole):
            assert sorted(t for _, t in epochs[e]) == sorted(sizes)
        # the next document of the order would not fit
        assert sum(t for _, t in epochs[whole]) <= rest
        assert rest - sum(t for _, t in epochs[whole]) < max([*sizes, 1])
    again = mixing.mix(docs, domain, {("web",): 0.2, ("books",): 0.8}, share=0.9, epochs=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_empty_table(spark):
    assert mixing.mix(odd.docs(spark, []), F.lit("x"), {}).collect() == []
