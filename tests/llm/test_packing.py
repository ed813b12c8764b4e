import random
import zlib
from collections import defaultdict

import numpy as np
from cases import frame, odd_documents, words

from loomspark.llm import packing as pk


def check(rows, ids_of):
    """Every id in exactly one piece, no gaps, full sequences or powers of two; rows of equal documents may mix."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    for doc_id, expected in ids_of.items():
        total = sum(len(e) for e in expected)
        assert sum(r.length for r in docs[doc_id]) == total
        if len(expected) == 1:
            at = 0
            for r in sorted(docs[doc_id], key=lambda r: r.start):
                ids = expected[0][at : at + r.length]
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, total, zlib.crc32(np.array(ids, "<u4").tobytes()))
                at += r.length


def test_packs_every_id_once(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(pk.default_vocabulary()), random.Random(8)
    rows = [*odd_documents(), *[(100 + i, words(rng, rng.randint(0, 900)), "en", "a", 0, "x", 1, "y") for i in range(60)]]
    ids_of = defaultdict(list)
    for r in rows:
        ids_of[r[0]].append([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])
    check(pk.pack(frame(spark, rows).repartition(2)).collect(), ids_of)
    assert pk.pack(frame(spark, [])).collect() == []


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(pk.default_vocabulary()), pk.Ids(pk.default_vocabulary()), random.Random(3)
    pieces = ["a", "É", "é", "'s", "'", "ﬁ", "İ", "Σ", "ΑΣ", " ", "\n", "\x0b", "\x85", " ", "<|endoftext|>", "<|start", "1", "٣", "!!", "日本", "🙂", "\x1c", "ſ", "THE", "Ö", "ß", "é", "µ", "×", "_"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert own.of(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_sum_of_squares_choice_is_minimal():
    rng, packer = random.Random(5), pk.Packer(0, 64)
    for doc in range(400):
        size = rng.randint(1, 60)
        before = packer.levels.copy()
        got = packer.level_for(size)
        costs = {}
        for level in [0, *[h for h in range(1, 64 - size + 1) if before[h]]]:
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 64:
                n[level + size] += 1
            costs[level] = int((n[:64] ** 2).sum())
        assert costs[got] == min(costs.values())
        packer.add(doc, bytes(4 * size))


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(pk, "OPEN_WINDOWS", 20)
    rng, packer, rows, ids_of = random.Random(7), pk.Packer(0), [], {}
    for doc in range(600):  # rests of over half a window fit no other
        ids = np.arange(doc, doc + rng.randint(1100, 2000), dtype="<u4")
        ids_of[doc] = [ids.tolist()]
        rows += packer.add(doc, ids.tobytes())
        assert packer.n_open == sum(map(len, packer.open)) == packer.levels[1:].sum() <= 20
    rows += packer.close()
    fields = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check([type("Row", (), dict(zip(fields, r, strict=True))) for r in rows], ids_of)


def test_other_vocabularies_go_through_the_library():
    from tokenizers import Tokenizer

    from loomspark.llm.token_counts import default_vocabulary

    library, own = Tokenizer.from_file(default_vocabulary()), pk.Ids(default_vocabulary())
    assert pk.Ids(pk.default_vocabulary()).ruled and not own.ruled
    for text in ("Two  words", " a\nb ", "it's 12", ""):
        assert own.of(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
