import numpy as np
import pyarrow as pa

from prismatica.llm import quality
from prismatica.llm.near_dedup import _sign
from prismatica.llm.textblocks import FAMILIES, PRIME, U, blocks, byte_windows, product, windows


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_products_modulo_the_prime():
    rng, p = np.random.default_rng(3), int(PRIME)
    a = np.append(rng.integers(0, p, 2000, dtype=np.uint64), [0, 1, p - 1, p - 1]).astype(U)
    b = np.append(rng.integers(0, p, 2000, dtype=np.uint64), [p - 1, p - 1, p - 1, 2]).astype(U)
    assert product(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist())]


def test_hashes_of_spans_are_polynomials():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    for power in FAMILIES:
        prefix = power.prefix(data)
        one = power.spans(prefix, np.array([0, 256, 512, 3]), np.array([200, 456, 712, 203]))
        assert one[0] == one[1] == one[2] != one[3]


def test_strings_that_collide_modulo_powers_of_two():
    for n in (1024, 2048, 4096):
        bits = thue_morse(n)
        one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
        assert int(quality.base_counts(next(blocks(pa.array([f"{one}\n{other}"]))))["n_dup_lines"][0]) == 0
        texts = [" ".join("ab"[b] for b in bits), " ".join("ba"[b] for b in bits), one, other]
        out = next(_sign(iter([pa.RecordBatch.from_pydict({"id": range(4), "key": range(4), "text": texts})])))
        assert len(set(zip(out.column("digest1").to_pylist(), out.column("digest2").to_pylist()))) == 4
        block = next(blocks(pa.array([one, other])))
        for family in (0, 1):
            hashes = byte_windows(block, 200, family)[1]
            text = one + other
            starts = [*range(n - 199), *range(n, 2 * n - 199)]
            assert len(set(hashes.tolist())) == len({text[i : i + 200] for i in starts})
        assert len(set(windows(next(blocks(pa.array(texts[:2]))), 512)[1].tolist())) == len({t[i : i + 1023] for t in texts[:2] for i in range(0, 2 * (n - 511), 2)})


def test_word_hashes_of_long_texts_do_not_depend_on_place():
    words = [f"wort{i % 977}" for i in range(200_000)] + ["x" * 700_000, "wort5"]
    block = next(blocks(pa.array([" ".join(words)])))
    alone = {w: int(next(blocks(pa.array([w]))).word_hash()[0]) for w in {*words}}
    assert block.word_hash().tolist() == [alone[w] for w in words] and len({*alone.values()}) == len(alone)
