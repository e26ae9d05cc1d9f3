"""Spellings that the decoder is to see through, and the shortcut before it, which may leave out nothing that would count."""

import random

import numpy as np
import pandas as pd
import pytest

from talus.llm import toxicity

CUES = ("idiot", "moron", "stupid")


@pytest.fixture(scope="module")
def scorer():
    """A character model of a few plain words, and made-up odds of cues."""
    rng = random.Random(0)
    text = " ".join(rng.choices("an here was the idiot moron stupid talk with them that is read you are".split(), k=400))
    cells = next(toxicity.count_characters(iter([pd.DataFrame({"text": [text]})])))
    counts = np.zeros(toxicity.N_CLASSES**3, np.int64)
    counts[cells["cell"]] = cells["n"]
    return toxicity.Scorer(toxicity.Decoder(counts), {cue: 4.0 for word in CUES for cue in toxicity.cues(word)})


FOUND = ["idiot", "id iot", "1d10t", "i d 1 0 t", "id 1ot", "1d iot", "m0 ron", "mo r0n", "!diot", "idiiot", "(idiot)", "idio t", "moorron", "stup id", "st, upid", "i.d iot", "m o r o n s t u p i d"]


@pytest.mark.parametrize("spelling", FOUND)
def test_found(scorer, spelling):
    assert scorer.evidence(f"was the {spelling} here")[0] > 0


@pytest.mark.parametrize("text", ["read that was", "too good (with) them!", "!read (here", "coon", "i d", "an i d o t", "", None])
def test_not_found(scorer, text):
    assert scorer.evidence(text) == (0.0, 0.0)


def test_what_the_shortcut_turns_away_scores_nothing(scorer):
    rng = random.Random(1)
    turned_away = 0
    for _ in range(8000):
        run = ["".join(rng.choices("abdeimnoprstu01!.,5", k=rng.randint(1, 4))) for _ in range(rng.randint(2, 4))]
        if rng.random() < 0.5:
            word = "".join({"i": rng.choice("i1!"), "o": rng.choice("o0"), "s": rng.choice("s5")}.get(c, c) for c in rng.choice(CUES))
            cut = rng.randint(max(1, len(word) - 4), min(4, len(word) - 1))
            run = [word[:cut], word[cut:], *run[:1]]
        if not scorer.readable(run):
            turned_away += 1
            for word in scorer.decoder.restore(" ".join(run)).split():
                word = "".join(c for c in word if c.isalpha())
                assert not any(scorer.best(word[k:]) for k in range(max(0, len(word) - 3)))
    assert turned_away > 2000


def test_a_word_without_a_reading_scores_nothing(scorer):
    rng = random.Random(2)
    skipped = 0
    for _ in range(20_000):
        word = "".join({"i": rng.choice("i1!|"), "o": rng.choice("o0*"), "s": rng.choice("s5$")}.get(c, c) for c in rng.choice(CUES))
        at = rng.randrange(len(word))
        word = rng.choice(["", "(", "!", "'"]) + word[:at] + rng.choice(["", word[at], word[at] * 2, ".", "-", "x", "9"]) + word[at:] + rng.choice(["", ".", "!!"])
        if rng.random() < 0.5:
            word = "".join(rng.choices("abdeimnoprstu01!.,5é", k=rng.randint(1, 9)))
        if not scorer.read.search(word):
            skipped += 1
            assert not scorer.best(scorer.decoder.clean(word))
            assert not any(scorer.best(other) for other, _ in scorer.decoder.others(word))
    assert skipped > 5000
