from tokenizers import Tokenizer

from packetloom.llm import token_counts
from packetloom.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.tiktoken")


def brute(df):
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))  # the same vocabulary, in another library
    t.encode_special_tokens = True
    return sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect())


def test_every_limit(docs, odd, none):
    for df in (docs, odd):
        n = brute(df)
        got = {r.n_tokens: r for r in token_counts.by_limit(token_counts.histogram(token_counts.lengths(df, PATH)), block=64).collect()}
        assert set(got) == set(n)
        for limit, r in got.items():
            assert r.n_docs == n.count(limit)
            assert r.docs_at_least == sum(x >= limit for x in n)
            assert r.tokens_at_least == sum(x for x in n if x >= limit)
            assert r.kept_tokens == sum(min(x, limit) for x in n)
            assert r.lost_tokens == sum(n) - r.kept_tokens and r.total_tokens == sum(n)
            assert abs(r.quantile - sum(x <= limit for x in n) / len(n)) < 1e-12
    assert token_counts.count_tokens(none, PATH).count() == 0


def test_quantile(docs):
    n = brute(docs)
    assert token_counts.quantile(token_counts.count_tokens(docs, PATH), 0.5).first()[0] == n[(len(n) + 1) // 2 - 1]


def test_limits_between_lengths(docs, none):
    n, limits = brute(docs), (1, 77, 2048, 10**7)
    got = {r.n_tokens: r for r in token_counts.count_tokens(docs, PATH, limits=limits).collect()}
    assert set(got) == set(n) | set(limits)
    for limit in limits:
        r = got[limit]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (n.count(limit), sum(x >= limit for x in n), sum(x for x in n if x >= limit))
        assert r.kept_tokens == sum(min(x, limit) for x in n) and abs(r.quantile - sum(x <= limit for x in n) / len(n)) < 1e-12
    assert token_counts.count_tokens(none, PATH, limits=limits).count() == 0
