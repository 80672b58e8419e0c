import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def slow_rule(sizes, capacity, opening=True):
    """The sum-of-squares rule, by trying every open bin and, where that is a choice, a new one."""
    gaps, left = [], []
    for s in sizes:
        count = defaultdict(int)
        for g in gaps:
            if g:
                count[g] += 1
        best = None
        for g in sorted(count) + [capacity] * opening:
            if g >= s:
                after = dict(count)
                if g < capacity:
                    after[g] -= 1
                if g - s:
                    after[g - s] = after.get(g - s, 0) + 1
                total = sum(x * x for x in after.values())
                if best is None or total < best[0]:
                    best = (total, g)
        if best is None or best[1] == capacity:
            gaps.append(capacity)
            k = len(gaps) - 1
        else:
            k = max(i for i, g in enumerate(gaps) if g == best[1])
        gaps[k] -= s
        left.append(gaps[k])
    return left, len(gaps)


@pytest.mark.parametrize("opening", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_rule_matches_trying_all_bins(seed, opening):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 40) for _ in range(120)]
    where, offset, filled = packing.sum_of_squares(sizes, 40, opening)
    left, bins = slow_rule(sizes, 40, opening)
    # the gap that each item leaves is the rule's choice; which of equal bins takes it is free
    assert [40 - o - s for o, s in zip(offset.tolist(), sizes, strict=True)] == left and len(filled) == bins


@pytest.mark.parametrize("seed", range(4))
def test_bins_left_open_are_packed_again(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 60) for _ in range(400)), reverse=True)
    where, offset, filled = packing.best_fit(sizes, 64)
    by = defaultdict(list)
    for b, o, s in zip(where.tolist(), offset.tolist(), sizes, strict=True):
        by[b].append((o, s))
    assert sorted(by) == list(range(len(filled)))
    for b, parts in by.items():
        at = 0
        for o, s in sorted(parts):
            assert o == at
            at += s
        assert at == filled[b] <= 64
    assert len(filled) <= len(packing.sum_of_squares(sizes, 64)[2]) and sum(filled * 2 <= 64) <= 1


def check(found, capacity):
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def wanted(rows, tokenizer, capacity):
    out = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((key, piece, at, len(part), zlib.crc32(array("I", part).tobytes())))
    return sorted(out, key=repr)


def shown(found):
    return sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr)


@pytest.mark.parametrize(("capacity", "shard"), [(2048, packing.SHARD_PIECES), (64, 20), (7, 300)])
def test_pieces_and_places(docs, rows, tokenizer, capacity, shard):
    found = packing.pack(docs, capacity=capacity, shard_pieces=shard).collect()
    assert shown(found) == wanted([r[:2] for r in rows], tokenizer, capacity)
    sequences, total = check(found, capacity), sum(r.length for r in found)
    assert sequences <= 1.1 * total / capacity + 2


def test_repeated_rows_null_keys_and_clashing_names(odd, tokenizer):
    found = packing.pack(odd).collect()
    assert shown(found) == wanted([(r.doc_id, r.text) for r in odd.collect()], tokenizer, 2048)
    check(found, 2048)


def test_reruns_agree(docs):
    assert sorted(packing.pack(docs).collect()) == sorted(packing.pack(docs).collect())


def test_empty(nothing):
    assert packing.pack(nothing).count() == 0


ODD = ["a", "Ab", "the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", ",", ".", ". ", "'", "'s", "'LL", "don't", "\xe9", "\xdf", "\u0130", "J\u030c", "\u0149", "\u017f", "\ufb01", "\u0391\u03a3", "1", "23", "!", "#$%", "(x)", "\x7f", "\x00", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u200b", "\u3000", "\ufeff", "\u212b", "A\u030a", "\u01c5", "\u0301", "\u6f22\u5b57", "\U0001f600", "_", "-", "<|endoftext|>", "<|startoftext|>", "<|endof"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_whole_text_call(name, rows):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [r[1] for r in rows if r[1]]
    texts += [f"see {x} here" for x in ("<|endoftext|>", "<|startoftext|>", "\x1f", "\n\n\n")] + ["a line, of words.\n" * 20_000, ("odd  line\n" + "plain line\n") * 20_000]
    encode = tokens.encoder(public_tokenizers.path(name))
    for text in texts:
        assert encode(text) == array("I", t.encode(text, add_special_tokens=False).ids).tobytes(), ascii(text[:200])


def test_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "ENTRIES", 50)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, rng = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 60))) for _ in range(20))
        assert encode(text) == array("I", t.encode(text, add_special_tokens=False).ids).tobytes()
    assert all(len(x) <= 50 and len(x.older) <= 50 and max(map(len, x)) <= tokens.KEPT_CHARS + 1 for x in (encode.alone, encode.after_space) if x)


def test_other_files_take_the_plain_call(tmp_path):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        about = json.load(f)
    about["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(about))
    encode, t = tokens.Encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert encode.cut == encode.plain and encode("one two\n three") == array("I", t.encode("one two\n three", add_special_tokens=False).ids).tobytes()
