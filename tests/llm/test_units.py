"""The splitter of plain texts against the pattern, and ids of matches against their strings."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from siftwork.llm import units


def matches(texts):
    """The matches that Units finds, through an encoder that numbers strings."""
    names: dict = {}
    u = units.Units(units.PLAIN, lambda words: units.flat([[names.setdefault(w, len(names))] for w in words]), limit=500)
    back = lambda ids: [list(names)[i] for i in ids]
    flat, off = u.ids(pa.array(texts, pa.string()))
    return [back(flat[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]


CHARS = ["a", "Z", "s", "t", "re", "ve", "m", "ll", "d", "'", "'", " ", " ", "  ", "\n", "\t", "\r", "1", "9", ".", "-", "é", "ſ", "Ā", "ß", "¿", "«", "€", "–", "…", "×", "÷", "²", "º", "\x1c", "\x00", "　", "日", "😀", " ", " ", "'S", "\x85"]


@pytest.mark.parametrize("step", [units.STEP, 40])
def test_splits_like_the_pattern(monkeypatch, step):
    monkeypatch.setattr(units, "STEP", step)
    r = random.Random(step)
    pattern = regex.compile(units.PLAIN)
    texts = [None, "", "'", "'s", "a's", " 's", "\n's", "a'", "''s", "'ve 're'll", "x" * 300, "a  b", "a \n b\n", "  "]
    for _ in range(1500):
        some = CHARS[: r.choice([12, 20, 26, 31, len(CHARS)])]
        texts.append("".join(r.choice(some) for _ in range(r.randint(0, 30 if r.random() < 0.9 else 200))))
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert matches(part) == [pattern.findall(t or "") for t in part]


def test_table_holds_all():
    r = np.random.default_rng(1)
    table, seen = units.Table(), {}
    for _ in range(30):
        h = np.unique(r.integers(0, 2**63, 10_000).astype(np.uint64) << np.uint64(1))
        h = h[table.get(h) < 0]
        table.put(h, np.arange(len(seen), len(seen) + len(h)))
        seen.update(zip(h.tolist(), range(len(seen), len(seen) + len(h)), strict=True))
    keys = np.array(list(seen), np.uint64)
    assert table.get(keys).tolist() == list(seen.values())
    assert (table.get(keys + np.uint64(1)) == -1).all()


def test_joined_words_have_the_library_s_ids():
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from siftwork.llm import packing

    r = random.Random(4)
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = packing.Tokenizer(f.read(), P.PATTERN)
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["".join(r.choice(CHARS + [" the", "tion", "日本 ", "éàü"]) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["x <|endoftext|> y", None, " a" * 600]
    got = [x.tolist() for x in own.ids(pa.array(texts, pa.string()))]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("together", [None, False])
def test_words_of_any_length_by_the_recursive_query(together):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    from siftwork.llm import byte_bpe

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        data = f.read()
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(data), special_tokens={})
    own = byte_bpe.ByteBPE(data, P.PATTERN, together)
    assert own.together is (together is None)
    r = random.Random(9)
    words = ["a" * n for n in range(1, 70)] + ["ab" * n + "a" for n in range(1, 30)] + ["ana" * 300, "日本" * 400, "a" * 3000, "é" * 501]
    words += ["".join(r.choice(c) for _ in range(r.randint(1, 30))) for c in ("aab", "abcdefghijklmnopqrstuvwxyz", "éaœ日") for _ in range(300)]
    words += ["".join(r.choice("etaoinsh") for _ in range(1500))]
    assert [list(x) for x in own.words([w.encode() for w in words])] == [coder.encode_ordinary(w) for w in words]


def test_a_vocabulary_with_unreachable_tokens_contracts_one_pair_at_a_time():
    import base64

    from siftwork.llm import byte_bpe

    ranks = [bytes([i]) for i in range(256)] + [b"abc", b"bc", b"cc", b"ab", b"bca"]  # abc ranks before its parts
    data = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(ranks))
    own = byte_bpe.ByteBPE(data, r"\w+")
    assert not own.together

    def merged(word):
        parts = [bytes([x]) for x in word]
        while True:
            pairs = [(ranks.index(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks.index(p) for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(6)
    words = ["".join(r.choice("abc") for _ in range(r.randint(2, 20))).encode() for _ in range(500)]
    words = [w for w in words if w not in ranks]
    assert [list(x) for x in own.words(words)] == [merged(w) for w in words]
