"""Hyperdimensional bundles, letter by letter."""

import numpy as np

from lumenlake.llm import language_id


def naive_bundle(text):
    """The sum of bound trigram vectors, letter by letter."""
    letters, symbols = language_id._letters(language_id.DIM, language_id.SEED), language_id._symbols()
    s = [0]
    for c in (text or "") + " ":
        code = int(symbols[ord(c)])
        if code or s[-1]:
            s.append(code)
    out = np.zeros(language_id.DIM)
    if not any(s):
        return out
    if s[-1]:
        s.append(0)
    for i in range(len(s) - 2):
        out += np.roll(letters[s[i]], 2) * np.roll(letters[s[i + 1]], 1) * letters[s[i + 2]]
    return out
