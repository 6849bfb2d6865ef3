"""Surrogates of very long and many-dotted entities: no overflow, time in proportion, nothing that repeats."""

import re
import time

from pyspark.sql import functions as F

from tarnwell.llm import pii


def test_long_entities_end(spark):
    digits = "".join(f"{i * 2654435761 % (1 << 32):08x}" for i in range(1 << 17))
    cases = {
        "labels": "x@" + "a." * 100_000, "domain": "see me@" + "aa." * 120 + "com now", "beyond": "me@" + "aa." * 3000 + "com", "hex": "key " + digits + " end", "name": "Mr A" + "-bb" * 100_000, "names": "Mr Ab-" + "cd’ef-" * 20_000 + "g",
        "hyphens": "x@a" + "-" * 200_000 + "b.com", "clean": "clean",
    }
    rows = spark.createDataFrame(list(cases.items()), "doc_id string, text string").repartition(4)
    began = time.perf_counter()
    found = {r.doc_id: r for r in pii.replace(rows.withColumn("doc_id", F.col("doc_id"))).collect()}
    assert time.perf_counter() - began < 200 and set(found) == set(cases)
    for name in ("labels", "clean"):
        assert found[name].text == cases[name] and found[name].pii_found == []
    assert found["domain"].pii_found == ["email"] and "aa.aa" not in found["domain"].text and found["domain"].text.endswith(" now")
    drawn = found["hex"].text[4:-4]
    assert len(drawn) == len(digits) and re.fullmatch("[0-9a-f]+", drawn) and drawn != digits
    assert len({drawn[i:i + 20] for i in range(0, len(drawn) - 20, 20)}) > 0.99 * (len(drawn) // 20 - 1)


def test_the_mapping_is_recomputed(spark):
    """Surrogates of digits and letters by the rule in Python: number n of the stream for the n-th letter or digit."""
    import hashlib

    def stream(*parts):
        seed = "\x1f".join(parts).encode()
        return hashlib.sha256(seed).hexdigest() + hashlib.sha256(seed + b"\x1f+").hexdigest()

    def drawn(e, own, low="abcdefghijklmnopqrstuvwxyz"):
        out, n = [], 0
        for c in e:
            at = int(own[n % 62 * 2:n % 62 * 2 + 4], 16)
            n += c.isalnum()
            kinds = {"d": "0123456789", "l": low, "u": low.upper()}
            kind = "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else ""
            out.append(kinds[kind][at % len(kinds[kind])] if kind else c)
        return "".join(out)

    def shaped(e, own, **how):
        pieces = [e[i:i + pii.PIECE] for i in range(0, len(e), pii.PIECE)]
        return "".join(drawn(p, own if i == 0 else stream("", own, str(i)), **how) for i, p in enumerate(pieces))

    secret, token, ssn, phone = "0123456789abcdef" * 12, "ghp_" + "Ab3" * 40, "123-45-6789", "+49 30 1234567"
    rows = spark.createDataFrame([(x,) for x in (secret, token, ssn, phone)], "e string")
    got = [r[0] for r in rows.select(pii.surrogate(F.col("e"), F.lit(0))).collect()]
    own = lambda kind, norm: stream(pii.KEY, kind, norm, "0")
    assert got[0] == shaped(secret, own("secret", secret), low="abcdef") and got[1] == shaped(token, own("secret", token))
    assert got[2] == shaped(ssn, own("ssn", "123456789"))
    assert got[3] == "+49" + shaped(phone[3:], own("phone", "49301234567"))
