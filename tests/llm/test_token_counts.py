import random

from cases import frame, odd_documents

from loomspark.llm import token_counts as tc

PIECES = ["a", "b", "é", "'s", "'re", "'", " ", "  ", "\n", "\t", " ", "　", "1", "٣", "the", " The", "ing", "!", "...", "日本", "🙂", "<|endoftext|>", "<|endof", "'LL", "\x1c", "​", "x" * 5, "ab" * 40]


def test_counts_equal_the_library_at_any_chunk_size():
    from tokenizers import Tokenizer

    library, machine, rng = Tokenizer.from_file(tc.default_vocabulary()), tc.machine(tc.default_vocabulary()), random.Random(9)
    for _ in range(800):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert {machine.count(text, c) for c in (1, 3, 7, 16, 10**9)} == {want}, text


def test_many_special_strings():
    machine = tc.machine(tc.default_vocabulary())
    assert machine.count("<|endoftext|>a" * 5000) == 10000 == machine.count("<|endoftext|>a" * 5000, 1000)


def test_maps_compose_in_any_grouping():
    machine, rng = tc.machine(tc.default_vocabulary()), random.Random(3)
    plain = [p for p in PIECES if "<|" not in p]
    for _ in range(300):
        a, b, c = (machine.chunk("".join(rng.choice(plain) for _ in range(rng.randint(1, 9)))) for _ in range(3))
        assert machine.compose(machine.compose(a, b), c) == machine.compose(a, machine.compose(b, c))


def test_a_map_holds_for_every_state_before():
    """Any chunk behind any other: the map's state and count are those of walking all characters."""
    machine, rng = tc.machine(tc.default_vocabulary()), random.Random(5)
    plain = [p for p in PIECES if "<|" not in p]
    for _ in range(1500):
        before, text = ("".join(rng.choice(plain) for _ in range(rng.randint(0, 6))) for _ in range(2))
        if text:
            state, n = machine.run((), before)
            after, m = machine.applied(state, machine.chunk(text))
            assert (after, n + m) == machine.run((), before + text)
            assert n + m == machine.plain(before + text)


def test_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tc.default_vocabulary())
    got = tc.token_counts(frame(spark, odd_documents())).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in odd_documents()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tc.token_counts(frame(spark, [])).collect() == []
