"""Insults that few labelled texts have are learnt, however large the sample is."""

import random

import numpy as np

from seisframe.llm import toxicity

from .helpers import passage


def test_op9_learns_insults_of_one_text_in_a_hundred():
    rng = random.Random(6)
    insults = ["worthlump", "scoundrelish", "pathetica"]
    texts, labels = [], []
    for i in range(3000):
        words = passage(rng, 40)
        if i % 100 == 0:
            for _ in range(4):
                words[rng.randrange(40)] = insults[i // 100 % 3]
        texts.append(" ".join(words))
        labels.append(int(i % 100 == 0))
    table, _ = toxicity.train(texts, labels)

    def logit(text):
        b, w, _ = toxicity.subwords([text])
        return float(np.sum(w * table[b]))

    clean = [passage(rng, 40) for _ in range(200)]
    plain = [logit(" ".join(words)) for words in clean]
    rude = [logit(" ".join([*words[4:], *[insults[i % 3]] * 4])) for i, words in enumerate(clean)]
    assert min(rude) > max(plain)
