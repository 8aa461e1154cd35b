import hashlib
import re

from hypothesis import given, settings, strategies as st

from panelwright.llm import secrets
from panelwright.llm.queries import table
from tests.llm.sql import same_as_sql

PLAIN = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24),
}
KEYS = [
    "ghp_" + "a1B2" * 9, "xoxb-1234567890-abc", "sk_live_" + "x" * 20, "AIza" + "Q" * 35, "eyJhbGciOiJI.eyJzdWIiOiIx.abc",
    "-----BEGIN RSA PRIVATE KEY-----", "Bearer " + "z9" * 12, "ftp://me:pw@host",
]
TEXTS = [
    None, "", 'Token = "abcdef" token: abc SECRET=token : abcdefgh', "api_key='a.b/c=d' APIKEY=123456 password\n= abcdefg",
    "AKIA" + "A" * 16 + " AKIAB AKIA" + "Z9" * 30, "deadbeef" * 3 + " " + "f" * 23 + "x" + "0" * 24, "é梦 secret=abcdef",
    "\u017fecret=abcdef to\u212aen=abcdefgh", "token" * 40000, "a" * 200000, "token=" * 30000, " ".join(KEYS), "x".join(KEYS), "passwd" + " " * 50000 + "=x",
]


def plain(text):
    return sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, (pattern, good)) in enumerate(PLAIN.items())
                  for m in re.finditer(pattern, re.sub("[\u017f\u212a]", "#", text or "")) if good(m))


def test_rows(docs_of):
    docs = [*enumerate(TEXTS), (None, TEXTS[2]), (2, TEXTS[2]), (2, "another token=abcdef")]
    got = secrets.secrets(docs_of(docs)).collect()
    want = []
    for i, t in docs:
        spans = plain(t)
        want.append((str(i), *(sum(s[1] == k for s in spans) for k in range(3)),
                     hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    kinds = {s.split(":")[0] for r in got if r.doc_id == 11 for s in r.spans.split(",")}
    assert kinds >= {r.kind for r in secrets.RULES[3:]}
    assert secrets.secrets(docs_of([])).count() == 0


@given(st.sampled_from(secrets.RULES), st.data())
@settings(max_examples=300, deadline=None)
def test_a_match_meets_its_query(rule, data):
    text = data.draw(st.from_regex(rule.pattern, fullmatch=True)).lower()
    for group in secrets.trigram_query(rule.pattern):
        assert any(all(t in text for t in trigrams) for trigrams in group)


def test_queries():
    three = frozenset
    assert secrets.trigram_query("abcd") == ((three({"abc", "bcd"}),),)
    assert secrets.trigram_query("(abc|xyz)[0-9]+Qrs?t") == ((three({"abc"}), three({"xyz"})), (three({"qrs", "rst"}), three({"qrt"})))
    assert secrets.trigram_query("[0-9a-f]{24,}") == () and secrets.trigram_query("ab.cd") == ()
    by_kind = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert [kind for kind, query in by_kind.items() if not query] == ["hex"]


def test_only_candidates_are_verified(docs_of):
    docs = docs_of([(1, "a token here"), (2, "to ken"), (3, "AKIA"), (4, "aki kia")])
    texts = secrets.documents(docs)
    queries = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.BASE[:2]}
    grams = sorted({t for q in queries.values() for g in q for s in g for t in s})
    found = secrets.candidates(secrets.trigram_index(texts, grams), queries).collect()
    assert sorted(k for r in found for k in r.kinds) == ["access", "access", "assign"]


def test_query_matches_its_sql(spark):
    same_as_sql(spark, "op6_secrets")


def test_plan_is_native(spark):
    df = secrets.secrets(table(spark, "/root/testdata/sf0.001", "documents"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
