import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import evidence as ev
from skein.functions import model as md
from skein.functions import signal as sg
from skein.functions import tokens as tk


def test_byte_units():
    table = tk.byte_units()
    assert len(set(table)) == 256 and table[32] == "Ġ" and table[65] == "A"
    text = "naïve — 数字 \x00\n"
    assert tk.from_units(tk.to_units(text)) == text


def test_pretokens(spark):
    texts = ["don't stop 12!", "  two  spaces ", "x\n\ny", "héé 数字", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tk.pretokens(F.col("t")).alias("p")).collect()
    assert all("".join(r.p) == r.t for r in rows)
    assert rows[0].p == ["don", "'t", " stop", " 12", "!"]


def plain_bpe(counts, vocab_size):
    words = {tuple(w): n for w, n in counts.items()}
    base, merges = sorted({u for w in words for u in w}), []
    while len(base) + len(merges) < vocab_size:
        pairs = {}
        for w, n in words.items():
            for p in zip(w, w[1:]):
                pairs[p] = pairs.get(p, 0) + n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < 2:
            break
        merges.append(best)
        new = {}
        for w, n in words.items():
            key = tuple(tk.merged(list(w), best))
            new[key] = new.get(key, 0) + n
        words = new
    return base, merges


def test_bpe():
    counts = {"lowest": 3, "lower": 5, "newest": 6, "wider": 2, "aaaa": 4, "abab": 3, "x": 9}
    assert tk.train_bpe(counts, 30) == plain_bpe(counts, 30)
    base, merges = tk.train_bpe({tk.to_units(w): n for w, n in counts.items()}, 300)
    bpe = tk.Bpe(sorted({*tk.byte_units(), *base}), merges)
    for s in ("lowest newer", "aaaaa", "naïve 数字", "unseen \x07"):
        assert bpe.decode(bpe.encode([s])) == s
    assert len(bpe.encode(["lowest"])) < 6


def test_layout_and_json(tmp_path, spark):
    from skein.sources import readers

    ids = tk.layout(300)
    assert (ids["eot"], ids["sot"], ids["lang:en"], ids["translate"], ids["timestamp_begin"], ids["n_vocab"]) == (300, 301, 302, 401, 407, 1908)
    bpe = tk.Bpe(list(tk.byte_units()), [("a", "b")])
    path = tmp_path / "tokenizer.json"
    path.write_text(tk.tokenizer_json(bpe))
    vocab, added = readers.read_tokenizer(spark, str(path))
    assert vocab.count() == 257 and added.count() == 2 + len(tk.LANGUAGES) + len(tk.AFTER_LANGUAGES) + tk.N_TIMESTAMPS
    assert {r.tag for r in tk.language_run(added).collect()} == set(tk.LANGUAGES)
    broken = json.loads(path.read_text())
    broken["added_tokens"] = broken["added_tokens"][1:]
    path.write_text(json.dumps(broken))
    with pytest.raises(readers.MissingInput, match="endoftext"):
        readers.read_tokenizer(spark, str(path))


def test_grammar(spark):
    ids = tk.layout(100)
    b, head = ids["timestamp_begin"], [ids["sot"], ids["lang:en"], ids["transcribe"]]
    cases = {
        "ok": [*head, b, 5, 6, b + 64, b + 64, 7, b + 125, ids["eot"]],
        "missing sot": [1, *head[1:], ids["eot"]],
        "missing language": [head[0], 3, head[2], ids["eot"]],
        "missing task": [*head[:2], 3, ids["eot"]],
        "missing eot": [*head, 4],
        "unpaired timestamps": [*head, b, 4, ids["eot"]],
        "decreasing timestamps": [*head, b + 9, 4, b + 1, ids["eot"]],
    }
    df = spark.createDataFrame(list(cases.items()), "want string, seq array<int>").select("want", tk.grammar_check(F.col("seq"), ids).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_mel():
    bank = sg.filterbank()
    assert bank.shape == (80, 201) and (bank.max(axis=1) > 0).all()
    silence = sg.log_mel(np.zeros(1000, np.float32))
    assert silence.shape == (80, 3000) and np.ptp(silence) == 0
    t = np.arange(sg.RATE * 2) / sg.RATE
    mel = sg.log_mel((0.5 * np.sin(2 * np.pi * 1000 * t)).astype(np.float32))
    peak = mel[:, 50].argmax()
    centre = (bank[peak] * np.arange(201) * 40).sum() / bank[peak].sum()
    assert abs(centre - 1000) < 150 and mel.max() - mel.min() <= 2.0 + 1e-6


def test_waves(spark):
    wave = [0.5] * 32_000
    df = spark.createDataFrame([(wave,)], "w array<float>")
    r = df.select(sg.resampled(F.col("w"), 32_000).alias("r"), sg.peak_normalized(F.transform("w", lambda x: x * 4)).alias("p"), sg.pad_or_trim(F.col("w"), 40_000).alias("q")).first()
    assert len(r.r) == 16_000 and set(r.r) == {0.5} and abs(max(r.p) - 0.95) < 1e-6 and len(r.q) == 40_000 and r.q[-1] == 0
    quiet = np.concatenate([np.zeros(8000), np.ones(4000), np.zeros(8000)]).astype(np.float32)
    # the first frame with a voiced sample begins at 7680, the last at 11840; four hops before, five and a frame after
    assert sg.voiced_span(quiet) == (7680 - 640, 11840 + 400 + 800)
    assert sg.voiced_span(quiet * 0) == (0, len(quiet)) and sg.voiced_span(quiet[:399]) == (0, 399)
    at = 10 ** (-45 / 20)
    assert sg.voiced_span(np.concatenate([np.zeros(4000), np.full(4000, at * 0.999)])) == (0, 8000)
    assert sg.voiced_span(np.concatenate([np.zeros(4000), np.full(4000, at * 1.001)]))[0] > 0
    assert (sg.augment(quiet, "a") == sg.augment(quiet, "a")).all()
    room = sg.reverberated(np.eye(1, 20_000)[0], np.random.default_rng(1))
    assert abs((room**2).sum() - 1) < 1e-9 and (room[4000:9600] ** 2).sum() < 0.05
    dry = np.random.default_rng(2).standard_normal(500)
    wet, rng = sg.reverberated(dry, np.random.default_rng(3)), np.random.default_rng(3)
    n = int(rng.uniform(0.1, 0.6) * sg.RATE)
    impulse = rng.standard_normal(n) * np.exp(-np.log(1000) * np.arange(n) / n)
    impulse[0] = 1
    assert np.allclose(wet, np.convolve(dry, impulse / np.linalg.norm(impulse))[:500])


def test_spec_augment():
    """Only whole rows and spans are masked, with the mean, within the widths; every kind occurs."""
    mel = np.random.default_rng(0).random((80, 400))
    rows, spans = set(), set()
    for k in range(200):
        changed = sg.spec_augment(mel, f"k{k}") != mel
        whole_rows = changed.all(axis=1)
        whole_spans = changed[~whole_rows].all(axis=0)
        assert (changed == (whole_rows[:, None] | whole_spans[None, :])).all()
        assert np.allclose(sg.spec_augment(mel, f"k{k}")[changed], mel.mean())
        rows.add(int(whole_rows.sum()))
        spans.add(int(whole_spans.sum()))
    assert max(rows) <= 54 and max(spans) <= 40 and len(rows) > 20 and len(spans) > 10
    again = sg.spec_augment(mel, "k1")
    assert (again == sg.spec_augment(mel, "k1")).all() and (again != sg.spec_augment(mel, "k2")).any()


def test_shard_ready(spark):
    loud = [0.0] * 4000 + [2.0] * 12_000 + [0.0] * 4000
    rows = [(1, loud), (2, [0.5] * 9_599), (3, None), (4, [0.0] * 9_600)]
    got = {r.k: r for r in sg.shard_ready(spark.createDataFrame(rows, "k int, wave array<float>")).collect()}
    assert set(got) == {1, 4} and got[1].samples == len(got[1].wave) < 20_000 and abs(max(got[1].wave) - 0.95) < 1e-6
    assert got[4].wave == [0.0] * 9_600


def test_merges_in_the_cluster_are_those_of_the_driver(spark):
    text = "low lower lowest newer newest wide wider widest aaaa aaa été étés " * 3
    rows = spark.createDataFrame([(text, "")], "text string, translation string")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    a, b = tk.trained(spark, rows, 275), tk.trained(spark, rows, 275, driver_bytes=0)
    assert a.merges == b.merges and len(a.merges) > 10 and a.symbols == b.symbols


def test_heap_split_is_the_plain_one():
    rng = np.random.default_rng(5)
    bpe = tk.Bpe(list("abc"), [("a", "a"), ("b", "c"), ("aa", "a"), ("aa", "aa"), ("c", "b"), ("bc", "bc"), ("a", "bc")])

    def plain(word):
        word = list(word)
        while pairs := [(bpe.rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in bpe.rank]:
            _, i = min(pairs)
            word[i : i + 2] = [word[i] + word[i + 1]]
        return word

    for _ in range(400):
        w = "".join(rng.choice(list("abc"), rng.integers(0, 14)))
        assert bpe.split(w) == plain(w), w
    assert len(bpe.split("abc" * 50_000)) == 50_000


def test_sampling():
    z = np.array([0.0, -np.inf, 1.0, 2.0])
    a = [ev.sample(z, 1.0, ev.XorShift(k * 977)) for k in range(500)]
    assert a == [ev.sample(z, 1.0, ev.XorShift(k * 977)) for k in range(500)] and 1 not in a and len(set(a)) == 3
    rng = ev.XorShift(42)
    x = 43
    x ^= x >> 12
    x ^= (x << 25) % 2**64
    x ^= x >> 27
    assert rng.next() == ((x * 0x2545F4914F6CDD1D) % 2**64 >> 40) / 2**24


def test_compression_ratio():
    loop, natural = "thanks for watching " * 20, "the quick brown fox jumps over the lazy dog near the river bank"
    assert ev.compression_ratio_of(loop) > ev.REPETITIVE > ev.compression_ratio_of(natural) and ev.compression_ratio_of("") == 0
    assert ev.compression_ratio_of(loop) == len(loop) / len(zlib.compress(loop.encode()))


def test_timestamp_rules():
    sp = ev.Specials(eot=10, sot=11, timestamp_begin=20)
    z = np.zeros(120)
    allowed = lambda sampled, **k: set(np.flatnonzero(np.isfinite(ev.timestamp_rules(z, sampled, sp, **k))))
    assert allowed([]) == set(range(20, 71))
    assert allowed([20]) == set(range(11))
    assert allowed([20, 5]) == set(range(11)) | set(range(21, 120))
    assert allowed([20, 5, 30]) == {10} | set(range(30, 120))
    assert allowed([20, 5, 30, 30]) == set(range(11))
    assert allowed([], research=True) == (set(range(71)) - {10})
    assert allowed([20], research=True) == set(range(10, 120))
    assert ev.choose(np.array([1.0, 0.9] + [-9.0] * 18 + [0.5] * 9), sp) >= 20
    assert ev.choose(np.array([5.0, 0.9] + [-9.0] * 18 + [0.5] * 3), sp) == 0


def test_segments(spark):
    b = 100
    tokens = {1: [b, 5, 6, b + 50, b + 50, 7, b + 100], 2: [5, b + 10, b + 20, 8], 3: [b, b + 5], 4: [9]}
    rows = [(k, p, t, 1.5, 30.0) for k, ts in tokens.items() for p, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k int, pos int, token int, window_seconds double, offset double")
    got = sorted((r.k, r.segment, round(r.start, 2), round(r.end, 2), list(r.ids)) for r in ev.segments(df, "k", b).collect())

    def plain(ts):
        out, start, text = [], 0.0, []
        for t in ts:
            if t < b:
                text.append(t)
                continue
            at = min((t - b) * 0.02, 1.5)
            if text:
                out.append((start, at, text))
                text = []
                start = at
            else:
                start = at
        return out + ([(start, 1.5, text)] if text else [])

    want = sorted((k, n, round(30 + a, 2), round(30 + e, 2), x) for k, ts in tokens.items() for n, (a, e, x) in enumerate(plain(ts), 1))
    assert got == want
    assert ev.paired_segments([b, 5, b + 9, b + 9, 6, b + 20, b + 30], b, 50, 1.5) == [(0.0, 0.18, [5]), (0.18, 0.4, [6])]
    assert ev.paired_segments([5, 6], b, 50, 1.5) == [(0.0, 1.5, [5, 6])]


def test_greedy_ends():
    sp = ev.Specials(eot=3, sot=4, timestamp_begin=5)

    def step(prefix, tokens):
        z = np.full(60, -5.0)
        z[{0: 5, 1: 1, 2: 3}.get(len(tokens), 3)] = 9
        return z

    tokens, logprob = ev.Greedy(step, sp).run([4])
    assert tokens == [5, 1] and -0.1 < logprob < 0


def test_model():
    sizes = md.Sizes()
    w = md.random_weights(sizes)
    m = md.Model(sizes, w)
    audio = m.encode(np.random.default_rng(1).random((sizes.mels, 2 * sizes.audio_context)))
    assert audio.shape == (sizes.audio_context, sizes.state) and m.encode(np.zeros((sizes.mels, 40))).shape == audio.shape
    tokens = [1, 2, 3, 4, 5, 6]
    whole = m.decode(tokens, audio)
    assert whole.shape == (6, sizes.vocab)
    changed = m.decode([*tokens[:3], 9, 9, 9], audio)
    assert np.allclose(whole[:3], changed[:3]) and not np.allclose(whole[3], changed[3])  # causal
    cache: dict = {}
    parts = np.concatenate([m.decode(tokens[:2], audio, cache), m.decode(tokens[2:3], audio, cache), m.decode(tokens[3:], audio, cache)])
    assert np.allclose(whole, parts)  # the cache changes nothing
    report = md.parameter_report(w)
    assert report["total"] == report["encoder"] + report["decoder"] == sum(x.size for x in w.values())


def test_model_over_recordings(spark):
    df = spark.createDataFrame([("a", [0.1] * 100), ("b", [])], "utt_id string, wave array<float>")
    rows = md.encoded(df, md.Sizes()).collect()
    assert {(r.utt_id, r.window, len(r.state)) for r in rows} == {("a", 0, 32), ("b", 0, 32)}


@pytest.mark.parametrize("context", [20, 1500])
def test_model_reads_every_sample(spark, context):
    rng = np.random.default_rng(2)
    wave = rng.standard_normal(14_000).astype(np.float32)
    late = wave.copy()
    late[13_000:] = rng.standard_normal(1000)
    df = spark.createDataFrame([("a", wave.tolist()), ("b", late.tolist())], "utt_id string, wave array<float>")
    states = {(r.utt_id, r.window): r.state for r in md.encoded(df, md.Sizes(audio_context=context)).collect()}
    last = {20: 2, 1500: 0}[context]
    assert set(states) == {(u, k) for u in "ab" for k in range(last + 1)}
    assert all((states["a", k] == states["b", k]) == (k < last) for k in range(last + 1))


def test_encoder_states_cover_thirty_seconds(spark, sf_dir):
    from skein.plans import decoding

    got = {r.utt_id: r.state for r in decoding.encoder_states(spark, sf_dir).collect()}
    sizes = md.Sizes(audio_context=sg.N_FRAMES // 2)
    model = md.Model(sizes, md.random_weights(sizes))
    for r in decoding._waves(spark, sf_dir).limit(2).collect():
        assert np.allclose(got[r.utt_id], model.encode(sg.log_mel(np.asarray(r.wave, np.float32), sizes.mels)).mean(axis=0))


def test_encoder_states_run_in_many_tasks(spark, sf_dir):
    """Few bytes of waves are much work, so they are not left to one task."""
    from skein.plans import decoding

    ids = decoding.encoder_states(spark, sf_dir).select(F.spark_partition_id().alias("task")).distinct().count()
    assert ids >= min(spark.sparkContext.defaultParallelism, decoding._waves(spark, sf_dir).count())


@pytest.mark.parametrize("scale", [1, 40])
@pytest.mark.parametrize("causal", [False, True])
def test_attention_by_blocks_of_queries(scale, causal):
    sizes = md.Sizes(state=8, heads=2)
    w = {k: v * scale for k, v in md.random_weights(sizes).items()}
    m, name, n = md.Model(sizes, w), "encoder.blocks.0.attn", 2 * md.ROWS + 3
    x = np.random.default_rng(3).standard_normal((n, 8))
    q, k, v = (m.dense(f"{name}.{p}", x) for p in ("query", "key", "value"))
    mask = np.triu(np.ones((n, n), bool), 1) if causal else None
    want = np.empty((n, 8))
    for h in (slice(0, 4), slice(4, 8)):
        z = q[:, h] @ k[:, h].T / 2
        if causal:
            z[mask] = -np.inf
        z = np.exp(z - z.max(axis=1, keepdims=True))
        want[:, h] = z / z.sum(axis=1, keepdims=True) @ v[:, h]
    assert np.allclose(m.attention(name, x, k, v, mask), m.dense(f"{name}.out", want))


@pytest.mark.parametrize("n", [0, 67, 16_000, 479_798, 479_799, 480_000, 490_000])
def test_log_mel_leaves_out_only_empty_frames(n):
    wave = np.random.default_rng(n).standard_normal(n).astype(np.float32)
    audio = np.zeros(sg.N_SAMPLES, np.float32)
    audio[: min(n, sg.N_SAMPLES)] = wave[: sg.N_SAMPLES]
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(audio, 200, mode="reflect"), 400)[::160][:3000]
    power = np.abs(np.fft.rfft(frames * 0.5 * (1 - np.cos(np.pi * np.arange(400) / 200)), axis=1)) ** 2
    mel = np.log10(np.maximum(sg.filterbank(8) @ power.T, 1e-10))
    assert np.allclose(sg.log_mel(wave, 8), (np.maximum(mel, mel.max() - 8) + 4) / 4, atol=1e-6)
    assert len(sg.power_frames(wave)) == min(3000, -(-(n + 200) // 160))


def test_greedy_tokens_run_to_the_limit(spark, sf_dir):
    from skein.plans import decoding

    got = {r.vec_id: r.tokens for r in decoding.greedy_tokens(spark, sf_dir).collect()}
    some = decoding.s.table(spark, sf_dir, "embeddings").limit(5).collect()
    for r in some:
        z = np.asarray(r.embedding, np.float64)
        assert got[r.vec_id] == ev.Greedy(lambda prefix, tokens: np.roll(z, 7 * len(tokens)) * 8, decoding.SPECIALS, longest=224).run([41])[0]
    assert max(map(len, got.values())) > 31


def test_log_mel_of_all_users(spark, sf_dir):
    from skein.plans import arrays

    got = {r.user_id: (r.n, r.hi, r.span) for r in arrays.log_mel(spark, sf_dir).collect()}
    waves = arrays._waves(spark, sf_dir).collect()
    assert set(got) == {r.user_id for r in waves}
    for r in waves[:3]:
        mel = sg.log_mel(np.asarray(r.wave, np.float32) / 1000)
        assert np.allclose(got[r.user_id], (mel.size, mel.max(), np.ptp(mel)), atol=2e-3)
