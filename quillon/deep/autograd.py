"""Reverse-mode derivatives of numpy expressions, as far as the networks here need them."""

from __future__ import annotations

import numpy as np


class Tensor:
    """An array with its derivative and the way back to what it was made of."""

    def __init__(self, data, parents: tuple = ()):
        self.data = np.asarray(data, float)
        self.grad = np.zeros_like(self.data)
        self.parents = parents  # (tensor, function from own derivative to its part)

    @property
    def shape(self) -> tuple[int, ...]:
        return self.data.shape

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p, _ in node.parents]
        self.grad = np.ones_like(self.data)
        for node in reversed(order):
            for parent, part in node.parents:
                parent.grad = parent.grad + _fit(part(node.grad), parent.shape)

    def __add__(self, other):
        other = tensor(other)
        return Tensor(self.data + other.data, ((self, lambda g: g), (other, lambda g: g)))

    def __mul__(self, other):
        other = tensor(other)
        return Tensor(self.data * other.data, ((self, lambda g: g * other.data), (other, lambda g: g * self.data)))

    def __truediv__(self, other):
        return self * tensor(other) ** -1

    def __pow__(self, p: float):
        return Tensor(self.data**p, ((self, lambda g: g * p * self.data ** (p - 1)),))

    def __matmul__(self, other):
        other = tensor(other)
        return Tensor(self.data @ other.data, ((self, lambda g: g @ other.data.T), (other, lambda g: self.data.T @ g)))

    def __neg__(self):
        return self * -1.0

    def __sub__(self, other):
        return self + -tensor(other)

    def __rsub__(self, other):
        return tensor(other) + -self

    __radd__, __rmul__ = __add__, __mul__

    def __getitem__(self, at):
        def back(g):
            out = np.zeros_like(self.data)
            np.add.at(out, at, g)
            return out

        return Tensor(self.data[at], ((self, back),))

    @property
    def T(self):
        return Tensor(self.data.T, ((self, lambda g: g.T),))

    def reshape(self, *shape):
        return Tensor(self.data.reshape(*shape), ((self, lambda g: g.reshape(self.shape)),))

    def sum(self, axis=None, keepdims: bool = False):
        out = self.data.sum(axis=axis, keepdims=keepdims)

        def back(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return np.broadcast_to(g, self.shape)

        return Tensor(out, ((self, back),))

    def mean(self, axis=None, keepdims: bool = False):
        n = self.data.size if axis is None else self.shape[axis]
        return self.sum(axis, keepdims) * (1 / n)

    def exp(self):
        out = np.exp(np.clip(self.data, -700, 700))
        return Tensor(out, ((self, lambda g: g * out),))

    def log(self):
        return Tensor(np.log(np.maximum(self.data, 1e-300)), ((self, lambda g: g / np.maximum(self.data, 1e-300)),))

    def abs(self):
        return Tensor(np.abs(self.data), ((self, lambda g: g * np.sign(self.data)),))

    def leaky(self, slope: float = 0.01):
        """Leaky rectifier."""
        factor = np.where(self.data > 0, 1.0, slope)
        return Tensor(self.data * factor, ((self, lambda g: g * factor),))

    def sigmoid(self):
        out = 1 / (1 + np.exp(-np.clip(self.data, -500, 500)))
        return Tensor(out, ((self, lambda g: g * out * (1 - out)),))

    def softmax(self, axis: int = 1):
        shifted = self - self.data.max(axis=axis, keepdims=True)
        e = shifted.exp()
        return e / e.sum(axis, keepdims=True)


def tensor(x) -> Tensor:
    return x if isinstance(x, Tensor) else Tensor(x)


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum a derivative over the dimensions that were broadcast."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for k, size in enumerate(shape):
        if size == 1 and g.shape[k] != 1:
            g = g.sum(k, keepdims=True)
    return g


def squared_distances(x: Tensor, centres: Tensor) -> Tensor:
    """Rows of x to rows of centres."""
    return (x * x).sum(1, keepdims=True) + (centres * centres).sum(1).reshape(1, -1) - (x @ centres.T) * 2.0
