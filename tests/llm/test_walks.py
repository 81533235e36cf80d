"""The walks of benchmark decontamination: against plain loops, and recall at the edit limit."""

import numpy as np
import pytest

from landstream.llm import decontamination

from .test_small_tables import text


def test_hashes_are_those_of_the_walk():
    rng = np.random.default_rng(2)
    body = bytes(rng.integers(97, 105, 200).tolist())
    walk = decontamination.Walk.draw(24, 14, 5)
    got = walk.hashes(np.frombuffer(body, np.uint8))
    assert len(got) == len(body) - 24
    for at in range(len(got)):
        place, read = at, []
        for j in range(24):
            read.append((walk.sampled[j], body[place]))
            place += int(walk.moves[body[place]]) >> j & 1
        value = 0
        for sampled, letter in reversed(read):
            if sampled:
                value = (value * 0x9E3779B1 + int(walk.codes[letter])) % (1 << 32)
        assert got[at] == value * 0x9E3779B1 % (1 << 32) and walk.goes(body, at) == place


def edited(body: bytes, share: float, evenly: bool, rng) -> bytes:
    k, out, letters = int(share * len(body)), list(body), sorted(set(body))
    places = (np.arange(k) + rng.random()) * len(body) / k if evenly else rng.choice(len(body), k, replace=False)
    for p in sorted((int(p) for p in places), reverse=True):
        what = rng.integers(0, 3)
        if what == 0:
            out[p] = letters[rng.integers(len(letters))]
        elif what == 1:
            del out[p]
        else:
            out.insert(p, letters[rng.integers(len(letters))])
    return bytes(out)


@pytest.mark.parametrize("words", [2, 3, 6, 12, 35, 120, 700])
@pytest.mark.parametrize("evenly", [False, True])
def test_recall_up_to_the_edit_limit(words, evenly):
    rng = np.random.default_rng(words)
    block = decontamination.Items([(i, text(100 * words + i, words)) for i in range(30)])
    for share in (0.05, 0.08, 0.1):
        within = found = 0
        for i, body in zip(block.ids, block.texts, strict=True):
            if int(share * len(body)) == 0:
                continue
            raw = np.frombuffer(text(i, 30).encode() + b" " + edited(body, share, evenly, rng) + b" " + text(i + 9, 30).encode(), np.uint8)
            want = decontamination.part_distance(body, decontamination.plain(raw))
            if want[0] <= block.limits[i]:
                got = {r[1]: r[2:] for r in decontamination.find_in_group(block, np.array([0, len(raw)]), raw)}
                within += 1
                found += got.get(i) == want
        assert found >= 0.9 * within


def test_a_long_item_needs_no_more_memory_than_its_bytes():
    body = text(1, 20_000)
    block = decontamination.Items([(1, body)])
    held = sum(x.nbytes for i in block.indexes for x in (i.values, i.inside, i.section, i.filter)) + block.sections.nbytes
    assert held < 40 * len(body)
    raw = np.frombuffer((text(2, 50) + " " + body[:50_000] + "x" + body[50_001:] + " " + text(3, 50)).encode(), np.uint8)
    assert [r[1:3] for r in decontamination.find_in_group(block, np.array([0, len(raw)]), raw)] == [(1, 1)]
