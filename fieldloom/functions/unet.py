"""A U-Net regressor for one plane, in NumPy: layers with forward and backward passes, AdamW, training loop."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

MOMENTUM, EPS = 0.1, 1e-5


class Param:
    def __init__(self, value: np.ndarray):
        self.value, self.grad = value, np.zeros_like(value)
        self.m, self.v = np.zeros_like(value), np.zeros_like(value)


class Conv:
    """size x size convolution with padding that keeps the plane's shape."""

    def __init__(self, inputs: int, outputs: int, size: int, rng: np.random.Generator):
        bound = 1 / np.sqrt(inputs * size * size)
        self.size = size
        self.weight = Param(rng.uniform(-bound, bound, (outputs, inputs, size, size)))
        self.bias = Param(rng.uniform(-bound, bound, outputs))
        self.params, self.buffers = [self.weight, self.bias], []

    def forward(self, x: np.ndarray, train: bool) -> np.ndarray:
        c, h, w = x.shape
        k, pad = self.size, self.size // 2
        padded = np.pad(x, ((0, 0), (pad, pad), (pad, pad)))
        views = np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(1, 2))
        self.columns = np.ascontiguousarray(views.transpose(0, 3, 4, 1, 2)).reshape(c * k * k, h * w)
        self.shape = x.shape
        out = self.weight.value.reshape(len(self.bias.value), -1) @ self.columns + self.bias.value[:, None]
        return out.reshape(-1, h, w)

    def backward(self, grad: np.ndarray) -> np.ndarray:
        (c, h, w), k, pad = self.shape, self.size, self.size // 2
        flat = grad.reshape(grad.shape[0], -1)
        self.weight.grad += (flat @ self.columns.T).reshape(self.weight.value.shape)
        self.bias.grad += flat.sum(axis=1)
        back = (self.weight.value.reshape(grad.shape[0], -1).T @ flat).reshape(c, k, k, h, w)
        out = np.zeros((c, h + 2 * pad, w + 2 * pad))
        for i in range(k):
            for j in range(k):
                out[:, i : i + h, j : j + w] += back[:, i, j]
        return out[:, pad : pad + h, pad : pad + w]


class Norm:
    """Batch normalisation over the plane; running variance is unbiased."""

    def __init__(self, channels: int):
        self.gamma, self.beta = Param(np.ones(channels)), Param(np.zeros(channels))
        self.params, self.buffers = [self.gamma, self.beta], [np.zeros(channels), np.ones(channels)]

    def forward(self, x: np.ndarray, train: bool) -> np.ndarray:
        n = x[0].size
        mean, var = (x.mean(axis=(1, 2)), x.var(axis=(1, 2))) if train else self.buffers
        if train:
            for buffer, now in zip(self.buffers, (mean, var * n / max(1, n - 1)), strict=True):
                buffer += MOMENTUM * (now - buffer)
        self.scale = 1 / np.sqrt(var + EPS)
        self.normal = (x - mean[:, None, None]) * self.scale[:, None, None]
        return self.normal * self.gamma.value[:, None, None] + self.beta.value[:, None, None]

    def backward(self, grad: np.ndarray) -> np.ndarray:
        n = grad[0].size
        self.gamma.grad += (grad * self.normal).sum(axis=(1, 2))
        self.beta.grad += grad.sum(axis=(1, 2))
        g = grad * self.gamma.value[:, None, None]
        a, b = g.sum(axis=(1, 2))[:, None, None] / n, (g * self.normal).sum(axis=(1, 2))[:, None, None] / n
        return self.scale[:, None, None] * (g - a - self.normal * b)


class Relu:
    params: list = []
    buffers: list = []

    def forward(self, x: np.ndarray, train: bool) -> np.ndarray:
        self.on = x > 0
        return x * self.on

    def backward(self, grad: np.ndarray) -> np.ndarray:
        return grad * self.on


class Pool:
    """2 x 2 maximum; a last odd row or column is left out."""

    params: list = []
    buffers: list = []

    def forward(self, x: np.ndarray, train: bool) -> np.ndarray:
        c, h, w = self.shape = x.shape
        blocks = x[:, : h // 2 * 2, : w // 2 * 2].reshape(c, h // 2, 2, w // 2, 2).transpose(0, 1, 3, 2, 4).reshape(c, h // 2, w // 2, 4)
        self.at = blocks.argmax(axis=3)
        return blocks.max(axis=3)

    def backward(self, grad: np.ndarray) -> np.ndarray:
        c, h, w = self.shape
        blocks = np.zeros((*grad.shape, 4))
        np.put_along_axis(blocks, self.at[..., None], grad[..., None], axis=3)
        out = np.zeros(self.shape)
        out[:, : h // 2 * 2, : w // 2 * 2] = blocks.reshape(c, h // 2, w // 2, 2, 2).transpose(0, 1, 3, 2, 4).reshape(c, h // 2 * 2, w // 2 * 2)
        return out


def stretch(n: int, to: int) -> np.ndarray:
    """[to, n] linear interpolation with the corners aligned."""
    x = np.linspace(0, n - 1, to)
    left = np.minimum(x.astype(int), max(n - 2, 0))
    out = np.zeros((to, n))
    out[np.arange(to), left] += 1 - (x - left)
    out[np.arange(to), np.minimum(left + 1, n - 1)] += x - left
    return out


class Resize:
    params: list = []
    buffers: list = []

    def forward(self, x: np.ndarray, size: tuple[int, int]) -> np.ndarray:
        self.ay, self.ax = stretch(x.shape[1], size[0]), stretch(x.shape[2], size[1])
        return self.ay @ x @ self.ax.T

    def backward(self, grad: np.ndarray) -> np.ndarray:
        return self.ay.T @ grad @ self.ax


class Chain:
    def __init__(self, *layers):
        self.layers = layers
        self.params = [p for x in layers for p in x.params]
        self.buffers = [b for x in layers for b in x.buffers]

    def forward(self, x: np.ndarray, train: bool) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x, train)
        return x

    def backward(self, grad: np.ndarray) -> np.ndarray:
        for layer in reversed(self.layers):
            grad = layer.backward(grad)
        return grad


class UNet:
    """``depth`` levels of two convolutions each, widths base * 2 ** level, skips between both arms, 1 x 1 head."""

    def __init__(self, inputs: int, base: int = 64, depth: int = 5, seed: int = 0):
        rng = np.random.default_rng(seed)
        widths = [base << k for k in range(depth)]
        block = lambda i, o: Chain(Conv(i, o, 3, rng), Norm(o), Relu(), Conv(o, o, 3, rng), Norm(o), Relu())
        self.down = [block(i, o) for i, o in zip([inputs, *widths], widths, strict=False)]
        self.pools = [Pool() for _ in widths[1:]]
        self.ups = [Chain(Conv(o, i, 3, rng), Norm(i), Relu()) for i, o in zip(widths, widths[1:], strict=False)]
        self.doubles, self.fixes = [Resize() for _ in self.ups], [Resize() for _ in self.ups]
        self.joins = [block(2 * w, w) for w in widths[:-1]]
        self.head = Conv(base, 1, 1, rng)
        parts = [*self.down, *self.ups, *self.joins, self.head]
        self.params = [p for x in parts for p in x.params]
        self.buffers = [b for x in parts for b in x.buffers]

    def forward(self, x: np.ndarray, train: bool = False) -> np.ndarray:
        if min(x.shape[1:]) >> len(self.pools) < 1:
            raise ValueError(f"a plane of {x.shape[1]} x {x.shape[2]} is too small for {len(self.pools)} poolings")
        skips = [self.down[0].forward(x, train)]
        for pool, block in zip(self.pools, self.down[1:], strict=True):
            skips.append(block.forward(pool.forward(skips[-1], train), train))
        self.fixed = [False] * len(self.ups)
        x = skips.pop()
        for k in reversed(range(len(self.ups))):
            x = self.ups[k].forward(self.doubles[k].forward(x, (2 * x.shape[1], 2 * x.shape[2])), train)
            if x.shape[1:] != skips[k].shape[1:]:
                x, self.fixed[k] = self.fixes[k].forward(x, skips[k].shape[1:]), True
            x = self.joins[k].forward(np.concatenate([skips[k], x]), train)
        return self.head.forward(x, train)[0]

    def backward(self, grad: np.ndarray) -> None:
        g = self.head.backward(grad[None])
        skips = []
        for k in range(len(self.ups)):
            g = self.joins[k].backward(g)
            skips.append(g[: len(g) // 2])
            g = g[len(g) // 2 :]
            if self.fixed[k]:
                g = self.fixes[k].backward(g)
            g = self.doubles[k].backward(self.ups[k].backward(g))
        for k in reversed(range(len(self.pools))):
            g = self.pools[k].backward(self.down[k + 1].backward(g)) + skips[k]
        self.down[0].backward(g)

    def state(self) -> list[np.ndarray]:
        return [p.value.copy() for p in self.params] + [b.copy() for b in self.buffers]

    def load(self, state: list[np.ndarray]) -> None:
        for target, value in zip([p.value for p in self.params] + self.buffers, state, strict=True):
            target[...] = value

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, *[a.astype(np.float32) for a in self.state()])
        return out.getvalue()

    def from_bytes(self, data: bytes) -> UNet:
        with np.load(io.BytesIO(data)) as held:
            self.load([held[f"arr_{k}"] for k in range(len(held.files))])
        return self

    def first_layer_importance(self) -> np.ndarray:
        """Mean absolute first-layer weight of each input feature."""
        return np.abs(self.down[0].layers[0].weight.value).mean(axis=(0, 2, 3))


def loss_and_grad(pred: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean absolute error plus half the mean square over the mask, 0 where it is empty; and the gradient."""
    n = int(mask.sum())
    if not n:
        return 0.0, np.zeros_like(pred)
    e = np.where(mask, pred - target, 0.0)
    return float(np.abs(e).sum() / n + 0.5 * (e * e).sum() / n), (np.sign(e) + e) / n


@dataclass(frozen=True)
class Training:
    epochs: int = 800
    patience: int = 80
    rate: float = 1e-3
    decay: float = 1e-4
    base: int = 64
    depth: int = 5
    test_share: float = 0.2
    seed: int = 42


def adamw(params: list[Param], step: int, rate: float, decay: float, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> None:
    for p in params:
        p.value *= 1 - rate * decay
        p.m += (1 - betas[0]) * (p.grad - p.m)
        p.v += (1 - betas[1]) * (p.grad * p.grad - p.v)
        p.value -= rate * (p.m / (1 - betas[0] ** step)) / (np.sqrt(p.v / (1 - betas[1] ** step)) + eps)
        p.grad[...] = 0


def spatial_split(land: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Boolean plane of test cells: a share of the land cells, one at least, never all."""
    flat = np.flatnonzero(land.ravel())
    if not len(flat):
        raise ValueError("no valid land cell")
    n = min(max(1, round(len(flat) * share)), max(1, len(flat) - 1))
    test = np.zeros(land.size, bool)
    test[np.random.default_rng(seed).choice(flat, size=n, replace=False)] = True
    return test.reshape(land.shape)


def train(x: np.ndarray, y: np.ndarray, train_mask: np.ndarray, test_mask: np.ndarray, how: Training, seed: int) -> tuple[UNet, int, float]:
    """(network with its best state, best epoch, best score): full-plane steps until the test loss stops falling."""
    net = UNet(len(x), how.base, how.depth, seed)
    scored = test_mask if test_mask.any() else train_mask
    best, best_epoch, best_score, waited = None, -1, np.inf, 0
    for epoch in range(1, how.epochs + 1):
        _, grad = loss_and_grad(net.forward(x, train=True), y, train_mask)
        net.backward(grad)
        adamw(net.params, epoch, how.rate, how.decay)
        score, _ = loss_and_grad(net.forward(x), y, scored)
        if score < best_score:
            best, best_epoch, best_score, waited = net.state(), epoch, score, 0
        else:
            waited += 1
            if waited >= how.patience:
                break
    if best is None:
        raise RuntimeError("no epoch gave a finite score")
    net.load(best)
    return net, best_epoch, best_score
