import base64
import math
import random
import re
import time
from collections import Counter, defaultdict

from millrace.llm import secret_scan

KINDS = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]


def brute(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), rank, m.end(), kind, m.group()) for m in re.finditer(pattern, text or "", re.A) if len(m.group(group)) >= least]
    return sorted(found)


def tables(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, cuts int").repartition(4)


def test_base_spans_are_those_of_brute_force(spark):
    rng = random.Random(3)
    pool = ["token", "Secret", "=", ":", " ", "'", '"', "abc", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "😀", "é", "\n", "password", "api_key", "apikey", "x", "secretK", "."]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(1500)] + [None, "", "token=abcdef " * 2000, "token=abcdef", "token=abcdef"]
    found = {r.doc_id: [tuple(s) for s in r.base] for r in secret_scan.scan(tables(spark, texts)).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}


def test_random_tokens_are_found_and_structured_ones_left(spark):
    rng = random.Random(8)
    secrets = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(150)] + ["".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=32)) for _ in range(150)]
    plain = [f"user_profile_settings_2024_version/and_other_things{i}" for i in range(150)] + [f"thentherean{i}erethentionthe2thatthentherean" for i in range(150)]
    plain += ["550e8400-e29b-41d4-a716-446655440000", "0123456789" * 4, "a1" * 30, "averylongwordwithoutanydigitsatallinit"]
    texts = [f"see {t} there" for t in secrets + plain]
    found = {r.doc_id: [s.found for s in r.random] for r in secret_scan.scan(tables(spark, texts)).collect()}
    hits = sum(any(s.strip("=") in secrets[i].replace("=", "") for s in found[i]) for i in range(len(secrets)))
    assert hits >= 0.9 * len(secrets)
    assert sum(bool(found[len(secrets) + i]) for i in range(len(plain))) <= 2
    for i, t in enumerate(texts):
        for s in secret_scan.scan(tables(spark, [t])).first().random if i < 2 else []:
            assert t[s.start : s.end] == s.found


ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def chi_tail(x, df):
    """Upper tail of chi-squared by the series of the lower incomplete gamma function."""
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= y / n
        total += term
    return max(0.0, 1 - total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def battery(token):
    """(class, p values of the three tests) of a token, from their textbook definitions; None if it isn't tested."""
    if len(token) < 20 or not re.search("[0-9]", token) or not re.search("[A-Za-z]", token):
        return None
    name = next((n for n, alphabet in ALPHABETS.items() if set(token) <= set(alphabet)), None)
    if name is None or len(token) * math.log2(len(ALPHABETS[name])) < 96:
        return None
    k, n = len(ALPHABETS[name]), len(token)
    x = [ALPHABETS[name].index(c) for c in token]
    counts = Counter(x)
    chi = sum((counts[v] - n / k) ** 2 / (n / k) for v in range(k))
    high = [v >= k / 2 for v in x]
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    n1, n0 = sum(high), n - sum(high)
    mean_runs, var = 1 + 2 * n1 * n0 / n, 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
    z_runs = (runs - mean_runs) / math.sqrt(var) if var > 0 else 9.0
    mean = sum(x) / n
    around = sum((v - mean) ** 2 for v in x)
    r = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / around if around else None
    z_serial = (r + 1 / (n - 1)) * math.sqrt(n) if around else 9.0
    two_sided = lambda z: math.erfc(abs(z) / math.sqrt(2))
    upper = chi_tail(chi, k - 1)
    return f"{name}:{sum(n > m for m in (24, 32, 48, 96))}", (2 * min(upper, 1 - upper), two_sided(z_runs), two_sided(z_serial))


def labelled(rng, n):
    """(token, random or not) of many kinds and lengths."""
    out = []
    for _ in range(n):
        name = rng.choice(list(ALPHABETS))
        out.append(("".join(rng.choices(ALPHABETS[name], k=rng.choice([24, 32, 40, 64, 128]))), True))
    words = "get set user account service config handler message buffer stream index table value order item list page cache remote client server token".split()
    for _ in range(n):
        w = rng.choices(words, k=rng.randint(4, 12))
        out.append((rng.choice(["_".join(w) + str(rng.randrange(3000)), "/".join(w) + f"/v{rng.randrange(9)}", "".join(x.capitalize() for x in w) + str(rng.randrange(100)), "-".join(w) + f"-{rng.randrange(2000, 2030)}"]), False))
    return [(t, kind) for t, kind in out if battery(t)]


def test_tests_and_discoveries_are_those_of_brute_force(spark):
    tokens = labelled(random.Random(12), 700) + [("ab1" * 30, False), ("a" * 30 + "1" * 30, False), ("1a" * 64, False), ("0123456789abcdef" * 4, False)]
    df = tables(spark, [t for t, _ in tokens])
    seen = {r.row.doc_id: [(t.token.found, t.stratum, t.level) for t in r.tested] for r in secret_scan.looked(df).collect()}
    exact = lambda p: min(120, math.floor(-math.log10(max(min(1.0, 3 * p), 1e-7)) / 0.05))
    off = 0
    for i, (t, _) in enumerate(tokens):
        (found, stratum, level), (wanted, p) = seen[i][0], battery(t)
        assert (found, stratum) == (t, wanted)
        # the chi-squared tail comes from a normal approximation, within half a level of the exact one where it matters
        off += abs(level - exact(min(p))) > max(1, 0.1 * level)
    assert off <= 0.02 * len(tokens)
    classes = defaultdict(list)
    for i in seen:
        classes[seen[i][0][1]].append((seen[i][0][2], i))
    kept = set()
    for levels in classes.values():  # step-up: the largest number of tokens whose largest p is at most rate * number / all
        levels.sort(reverse=True)
        n = max((k for k in range(1, len(levels) + 1) if 10 ** (-0.05 * levels[k - 1][0]) <= 0.05 * k / len(levels)), default=0)
        least = levels[n - 1][0] if n else 1000
        kept |= {i for level, i in levels if level < least}
    reported = {r.doc_id for r in secret_scan.scan(df).collect() if r.random}
    assert reported == kept
    hits = sum(kind for i, (_, kind) in enumerate(tokens) if i in reported)
    precision, recall = hits / len(reported), hits / sum(kind for _, kind in tokens)
    print(f"precision {precision:.3f}, recall {recall:.3f} of {len(tokens)} labelled tokens")
    assert precision > 0.9 and recall > 0.9


def test_a_very_long_token_takes_seconds(spark):
    long = base64.b64encode(random.Random(1).randbytes(750_000)).decode()
    df = tables(spark, ["short k9Xb3QmZt7LwPq2Rv8YsAbCd", f"x {long} y", None])
    began = time.time()
    found = {r.doc_id: [(s.start, s.end) for s in r.random] for r in secret_scan.scan(df).collect()}
    assert found[1] == [(2, 1_000_002)] and found[2] == []
    assert time.time() - began < 60


def test_redaction_keeps_rows_and_columns(spark):
    texts = ["my token = 'abcdefgh1' and deadbeefdeadbeefdeadbeef99", None, "", "nothing"]
    out = secret_scan.redact(tables(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["my [secret]' and [secret]", None, "", "nothing"]
    assert [(r.row, r.cuts) for r in out] == [("clash", 1)] * 4


def test_redaction_of_overlapping_spans_leaves_no_part(spark):
    key = "k9Xb3QmZt7LwPq2Rv8Ys"
    texts = [f"é {key}_secret=hunter22, then", f"see https://x.org/{key}/token=value77 or token=value77", f"{key}_secret=hunter22 {key}_secret", "token=abcdef token=abcdef", "token=abcdef😀"]
    out = [r.text for r in secret_scan.redact(tables(spark, texts)).orderBy("doc_id").collect()]
    assert out[0] == "é [secret], then" and out[2:] == ["[secret] [secret]", "[secret] [secret]", "[secret]😀"]
    assert out[1].startswith("see https:/") and out[1].endswith("[secret] or [secret]") and key not in out[1] and "value77" not in out[1]


def test_empty_table(spark):
    assert secret_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert secret_scan.redact(tables(spark, ["x"]).limit(0)).collect() == []
