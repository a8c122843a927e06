"""A small encoder-decoder in numpy, for invariants and for windows within a task.

No trained weights are at hand; weights are random and seeded. Recordings are
independent, so inference is one task's loop over its recordings' windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .signal import HOP, N_SAMPLES, log_mel


#: Queries whose scores are held at a time: those of 1,500 keys stay in a core's cache.
ROWS = 32
#: Scores up to this size need no maximum taken off before their exponentials.
SAFE = 300.0


@dataclass(frozen=True)
class Sizes:
    state: int = 32
    layers: int = 2
    heads: int = 4
    vocab: int = 64
    text_context: int = 24
    audio_context: int = 20
    mels: int = 8


def sinusoid_table(length: int, channels: int) -> np.ndarray:
    step = np.log(10_000.0) / (channels // 2 - 1)
    angle = np.arange(length)[:, None] * np.exp(-step * np.arange(channels // 2))
    return np.concatenate([np.sin(angle), np.cos(angle)], axis=1)


def random_weights(sizes: Sizes, seed: int = 0) -> dict[str, np.ndarray]:
    """Scaled by the square root of the inputs; outputs on the residual path damped by depth."""
    rng, d, w = np.random.default_rng(seed), sizes.state, {}

    def dense(name: str, n_in: int, n_out: int, bias: bool = True, residual: bool = False) -> None:
        w[f"{name}.weight"] = rng.standard_normal((n_in, n_out)) / np.sqrt(n_in) / (np.sqrt(2 * sizes.layers) if residual else 1)
        if bias:
            w[f"{name}.bias"] = np.zeros(n_out)

    def norm(name: str) -> None:
        w[f"{name}.weight"], w[f"{name}.bias"] = np.ones(d), np.zeros(d)

    def block(name: str, cross: bool) -> None:
        for part in ("attn", "cross_attn") if cross else ("attn",):
            norm(f"{name}.{part}_ln")
            for p in ("query", "key", "value", "out"):
                dense(f"{name}.{part}.{p}", d, d, bias=p != "key", residual=p == "out")
        norm(f"{name}.mlp_ln")
        dense(f"{name}.mlp.0", d, 4 * d)
        dense(f"{name}.mlp.2", 4 * d, d, residual=True)

    dense("encoder.conv1", 3 * sizes.mels, d)
    dense("encoder.conv2", 3 * d, d)
    for k in range(sizes.layers):
        block(f"encoder.blocks.{k}", False)
        block(f"decoder.blocks.{k}", True)
    norm("encoder.ln_post")
    norm("decoder.ln")
    w["decoder.token_embedding.weight"] = rng.standard_normal((sizes.vocab, d)) * 0.02
    w["decoder.positional_embedding"] = rng.standard_normal((sizes.text_context, d)) * 0.01
    return w


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x * x * x)))


class Model:
    def __init__(self, sizes: Sizes, weights: dict[str, np.ndarray]):
        self.sizes, self.w = sizes, weights

    def dense(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.w[f"{name}.weight"] + self.w.get(f"{name}.bias", 0)

    def norm(self, name: str, x: np.ndarray) -> np.ndarray:
        y = (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)
        return y * self.w[f"{name}.weight"] + self.w[f"{name}.bias"]

    def heads(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), self.sizes.heads, -1).transpose(1, 0, 2)

    def attention(self, name: str, x: np.ndarray, keys: np.ndarray, values: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        q, k, v = self.heads(self.dense(f"{name}.query", x)), self.heads(keys), self.heads(values)
        q = np.ascontiguousarray(q / np.sqrt(q.shape[-1]))
        most = np.linalg.norm(q, axis=-1).max(axis=-1) * np.linalg.norm(k, axis=-1).max(axis=-1)
        k, v = np.ascontiguousarray(k.transpose(0, 2, 1)), np.concatenate([v, np.ones((*v.shape[:2], 1))], axis=2)
        p = np.empty((*q.shape[:2], v.shape[-1]))
        for a in range(0, len(x), ROWS):
            z = q[:, a : a + ROWS] @ k
            if mask is not None:
                z[:, mask[a : a + ROWS]] = -np.inf
            if not most.max() < SAFE:
                z -= z.max(axis=-1, keepdims=True)
            np.matmul(np.exp(z, out=z), v, out=p[:, a : a + ROWS])
        p = p[..., :-1] / p[..., -1:]  # the last column has the sums of the weights
        return self.dense(f"{name}.out", p.transpose(1, 0, 2).reshape(len(x), -1))

    def block(self, name: str, x: np.ndarray, audio: np.ndarray | None = None, cache: dict | None = None, causal: bool = False) -> np.ndarray:
        h = self.norm(f"{name}.attn_ln", x)
        k, v = self.dense(f"{name}.attn.key", h), self.dense(f"{name}.attn.value", h)
        if cache is not None:
            if name in cache:
                k, v = np.concatenate([cache[name][0], k]), np.concatenate([cache[name][1], v])
            cache[name] = (k, v)
        before = len(k) - len(x)
        mask = np.arange(len(k))[None, :] > np.arange(len(x))[:, None] + before if causal else None
        x = x + self.attention(f"{name}.attn", h, k, v, mask)
        if audio is not None:
            h, own = self.norm(f"{name}.cross_attn_ln", x), f"{name}.cross"
            if cache is None or own not in cache:
                both = self.dense(f"{name}.cross_attn.key", audio), self.dense(f"{name}.cross_attn.value", audio)
                if cache is not None:
                    cache[own] = both
            else:
                both = cache[own]
            x = x + self.attention(f"{name}.cross_attn", h, *both, None)
        return x + self.dense(f"{name}.mlp.2", gelu(self.dense(f"{name}.mlp.0", self.norm(f"{name}.mlp_ln", x))))

    def encode(self, mel: np.ndarray) -> np.ndarray:
        """(mels, frames) to states: two convolutions of width 3, the second by steps of two."""
        x = mel.T
        for name, step in (("encoder.conv1", 1), ("encoder.conv2", 2)):
            padded = np.pad(x, ((1, 1), (0, 0)))
            taps = np.stack([padded[k : k + len(x)] for k in range(3)], axis=1)[::step]
            x = gelu(self.dense(name, taps.reshape(len(taps), -1)))
        x = x + sinusoid_table(len(x), self.sizes.state)
        for k in range(self.sizes.layers):
            x = self.block(f"encoder.blocks.{k}", x)
        return self.norm("encoder.ln_post", x)

    def decode(self, tokens: list[int], audio: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """Logits after each token; with a cache, tokens are the new ones only."""
        done = cache.get("n", 0) if cache is not None else 0
        x = self.w["decoder.token_embedding.weight"][tokens] + self.w["decoder.positional_embedding"][done : done + len(tokens)]
        for k in range(self.sizes.layers):
            x = self.block(f"decoder.blocks.{k}", x, audio, cache, causal=True)
        if cache is not None:
            cache["n"] = done + len(tokens)
        return self.norm("decoder.ln", x) @ self.w["decoder.token_embedding.weight"].T


def parameter_report(weights: dict[str, np.ndarray]) -> dict[str, int]:
    rows: dict[str, int] = {}
    for name, x in weights.items():
        rows[name.split(".")[0]] = rows.get(name.split(".")[0], 0) + x.size
    return rows | {"total": sum(rows.values())}


def encoded(waves: DataFrame, sizes: Sizes, seed: int = 0) -> DataFrame:
    """(utt_id, window, state array) of waves (utt_id, wave), as many samples at a time
    as the audio context has frames for (30 seconds at 1,500 states): every sample
    is encoded, and a window's last samples are padded to its whole context. A window
    takes far longer than its bytes tell, so rows are dealt out by number."""
    span = min(N_SAMPLES, 2 * sizes.audio_context * HOP)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(sizes, random_weights(sizes, seed))
        for pdf in batches:
            rows = []
            for utt, wave in zip(pdf["utt_id"], pdf["wave"]):
                wave = np.asarray(wave, np.float32)
                for k, a in enumerate(range(0, max(len(wave), 1), span)):
                    mel = log_mel(wave[a : a + span], sizes.mels)[:, : 2 * sizes.audio_context]
                    rows.append((utt, k, model.encode(mel).mean(axis=0).tolist()))
            yield pd.DataFrame(rows, columns=["utt_id", "window", "state"])

    spark = waves.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return waves.repartition(tasks).mapInPandas(run, "utt_id string, window int, state array<double>")
