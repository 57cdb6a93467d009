"""What the trained operators gain: co-training by its exchange, and the forest on secrets that no rule of its own made."""

import random
import string

import numpy as np

from timberline.llm import quality, secrets


def test_exchange_improves_a_view():
    """Few labels, two independent views, many unlabelled rows: the poorer view learns from the better one."""
    rng = np.random.default_rng(4)
    way = rng.normal(size=12)

    def made(n):
        y = rng.integers(0, 2, n).astype(float)
        sign = (2 * y - 1)[:, None]
        return sign * np.array([2.0, 1.5]) + rng.normal(size=(n, 2)), 0.35 * sign * way + rng.normal(size=(n, 12)), y

    x, z, y = made(30)
    more_x, more_z, _ = made(4000)
    test_x, test_z, want = made(4000)
    right = {}
    for rounds in (0, 6):
        model = quality.co_train(x, z, y, np.ones(len(y)), lambda text, page: quality.lend(text, page, more_x, more_z, 0.95), rounds=rounds)
        _, page, both = model.scores(test_x, test_z)
        right[rounds] = [((p >= 0.5) == (want > 0)).mean() for p in (page, both)]
    assert right[6][0] > right[0][0] + 0.02
    assert right[6][1] >= right[0][1] - 0.005


def planted(n=400, seed=11):
    """id, text, the secret in it or None: settings, code, commands and prose by rules of their own."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    letters, lower_hex = string.ascii_letters + string.digits, "0123456789abcdef"
    secret = [
        lambda: ("export STRIPE_SECRET_KEY={}\n", "sk_live_" + pick(letters, 24)),
        lambda: ("aws_access_key_id = {}\nregion = eu-west-1\n", "AKIA" + pick(string.ascii_uppercase + "234567", 16)),
        lambda: ("aws_secret_access_key = {}\n", pick(letters + "+/", 40)),
        lambda: ('client = Client(token="{}")\n', pick(letters, 32)),
        lambda: ("db:\n  user: app\n  password: {}\n", pick(letters, 9) + "$" + pick(string.digits, 2)),
        lambda: ("curl -H 'Authorization: Bearer {}' https://api.host.net/v1/items", pick(letters, 48)),
        lambda: ("git clone with {} as the user", "ghp_" + pick(letters, 36)),
        lambda: ('"signing_secret": "{}",\n', pick(lower_hex, 64)),
        lambda: ("session cookie {} was in the log", "eyJ" + pick(letters, 24) + "." + pick(letters, 80) + "." + pick(letters, 43)),
        lambda: ("const apiKey = '{}';", pick(lower_hex, 32)),
    ]
    clean = [
        lambda: "merged {} into main yesterday".format(pick(lower_hex, 40)),
        lambda: "the file has sha256 {} and 3 parts".format(pick(lower_hex, 64)),
        lambda: "trace id {} took 30 ms".format("-".join(pick(lower_hex, k) for k in (8, 4, 4, 4, 12))),
        lambda: "call us at {} or write".format("00" + pick(string.digits, 14)),
        lambda: "see https://host.net/articles/2024/how-to-{}-tests-{}".format(pick(string.ascii_lowercase, 6), pick(string.digits, 4)),
        lambda: "def test_{}_{}_with_2_parts(self): pass".format(pick(string.ascii_lowercase, 7), pick(string.ascii_lowercase, 6)),
        lambda: "parcel {} has left the depot".format(pick(string.ascii_uppercase, 2) + pick(string.digits, 18)),
        lambda: "password = os.environ['DB_PASSWORD_{}']".format(pick(string.digits, 1)),
        lambda: "token: str | None = None  # set by the caller {}".format(pick(string.digits, 3)),
        lambda: "ISBN 978{} and ISSN 1234-567X".format(pick(string.digits, 10)),
    ]
    out = []
    for i in range(n):
        if i % 2:
            shape, value = secret[i // 2 % len(secret)]()
            out.append((i, "some words before it: \n" + shape.format(value), value))
        else:
            out.append((i, clean[i // 2 % len(clean)](), None))
    return out


def test_planted_secrets(spark):
    rows = planted()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = [r for r in secrets.scan(df).collect() if r.is_secret]
    want = {i: value for i, _, value in rows if value}
    texts = {i: text for i, text, _ in rows}
    assert all(texts[r.doc_id][r.start : r.end] == r.value for r in found)
    hits = {r.doc_id for r in found if r.doc_id in want and (r.value in want[r.doc_id] or want[r.doc_id] in r.value)}
    false = [r for r in found if r.doc_id not in hits]
    assert len(hits) >= 0.9 * len(want)
    assert len(false) <= 0.1 * len(found)
