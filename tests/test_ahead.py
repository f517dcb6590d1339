"""Abbreviations are found behind a look at their first letter, with the same results."""

import random
import re

from regsync.functions import text as X


def test_a_look_ahead_changes_no_result():
    rng = random.Random(5)
    pieces = [*"eemcjaxs", "ee", "em", "esc", "tec", "est", "prof", "profa", "dr", "dra", "pres", "sta", "sto", "nsra", "ns", "eem", "eeb", "eep", "eepp", "ceep", "ciep", "unicasul", "unicsul", "assis", "kubistchek", "ceja"]
    for _ in range(2000):
        t = "".join(rng.choice(pieces) + rng.choice(["", " ", "  "]) for _ in range(8))
        for p, new in X.ABBREVIATIONS:
            assert X._ahead(p).startswith("(?=") and re.sub(X._ahead(p), new, t) == re.sub(p, new, t)
