"""Brute-force versions of the pipeline's stages."""

import numpy as np
from test_fingerprints import slow_components, slow_simhash
from test_private_repeats import base, defaultdict


def first_of_groups(texts):
    prints = sorted((i, slow_simhash(t)) for i, t in texts.items())
    root = slow_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    return set(root.values())


def brute_kept(texts):
    """A character goes if all its bytes are covered by 200-byte strings that stand elsewhere too."""
    seen = defaultdict(int)
    raws = {i: t.encode() for i, t in texts.items()}
    for r in raws.values():
        for k in range(len(r) - 199):
            seen[r[k : k + 200]] += 1
    out = {}
    for i, r in raws.items():
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        text, at = [], 0
        for c in texts[i]:
            n = len(c.encode())
            if not gone[at : at + n].all():
                text.append(c)
            at += n
        out[i] = "".join(text)
    return out


def base_masked(text):
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in base(text)[1].split(",") if s))
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return out + text[at:]
