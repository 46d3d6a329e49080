"""Spilled subtrees whose strings share long starts, and strings that leave them."""

import random

import pytest

from kinfold.llm.exact_dedup import PatriciaTrie


@pytest.mark.parametrize("largest", [False, True])
def test_strings_that_leave_the_label_of_a_spilled_child(largest):
    r = random.Random(3)
    head = b"Licensed under the terms of " * 8
    trie, want = PatriciaTrie(budget=4000, largest=largest), {}
    for i in range(3000):
        tail = bytes(r.choice(b"ab") for _ in range(r.randrange(1, 9)))
        if i < 60:
            key = head + b"common middle part " * 3 + tail  # spilled with a long label
        else:
            cut = r.randrange(len(head) + 1)
            key = r.choice([head + tail, head[:cut], head[:cut] + b"#" + tail, head + b"common middle" + tail, head + b"common middle part " * 3 + tail, b"other " + tail])
        trie.insert(key, i)
        o, n = want.get(key, (i, 0))
        want[key] = (max(o, i) if largest else o, n + 1)
        if i == 59:
            assert any(k.spill is not None and len(k.label) > 200 for k in trie.root.kids.values())
    got = list(trie.items())
    assert len(got) == len(want) and {k: (o, c) for k, o, c in got} == want
