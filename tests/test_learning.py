"""U-Net layers against finite differences; fitting and prediction through Spark."""

import numpy as np
import pytest

from fieldloom.functions import unet
from fieldloom.operators import learn


@pytest.mark.parametrize("shape", [(16, 16), (9, 11)])
def test_gradients(shape):
    rng = np.random.default_rng(0)
    net = unet.UNet(2, base=2, depth=3, seed=1)
    x, y = rng.normal(size=(2, *shape)), rng.normal(size=shape)
    mask = rng.random(shape) < 0.7

    def loss():
        return unet.loss_and_grad(net.forward(x, train=True), y, mask)

    _, grad = loss()
    net.backward(grad)
    for p in net.params[:: max(1, len(net.params) // 12)]:
        at = tuple(rng.integers(s) for s in p.value.shape)
        old, eps = p.value[at], 1e-6
        p.value[at] = old + eps
        up = loss()[0]
        p.value[at] = old - eps
        down = loss()[0]
        p.value[at] = old
        assert abs((up - down) / (2 * eps) - p.grad[at]) < 1e-4 * max(1, abs(p.grad[at]))


def test_training_lowers_the_loss_and_restores_the_best_state():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1, 16, 16))
    y = 2 * x[0]
    mask = np.ones((16, 16), bool)
    test = unet.spatial_split(mask, 0.2, 5)
    how = unet.Training(epochs=60, patience=60, base=4, depth=2, rate=1e-2)
    net, epoch, score = unet.train(x, y, mask & ~test, test, how, 0)
    assert score < unet.loss_and_grad(np.zeros_like(y), y, test)[0] * 0.9 and epoch > 1
    assert np.isclose(unet.loss_and_grad(net.forward(x), y, test)[0], score)


def test_state_round_trip():
    net = unet.UNet(2, base=2, depth=2, seed=3)
    other = unet.UNet(2, base=2, depth=2, seed=4).from_bytes(net.to_bytes())
    x = np.random.default_rng(0).normal(size=(2, 8, 8))
    assert np.allclose(net.forward(x), other.forward(x), atol=1e-5)


def test_split_clamps():
    land = np.zeros((3, 3), bool)
    land[0, :2] = True
    assert unet.spatial_split(land, 0.9, 1).sum() == 1 == unet.spatial_split(land, 0.01, 1).sum()
    with pytest.raises(ValueError):
        unet.spatial_split(np.zeros((2, 2), bool), 0.2, 1)


def test_plane_too_small():
    with pytest.raises(ValueError):
        unet.UNet(1, base=1, depth=5).forward(np.zeros((1, 8, 8)))


def test_fit_and_predict(spark):
    rows = [(m, i, j, float(i + j + m), True, float(i), float(j)) for m in (5, 6) for i in range(8) for j in range(8)]
    cells = spark.createDataFrame(rows, "month int, iy int, ix int, value double, inside boolean, a double, b double")
    how = unet.Training(epochs=10, patience=5, base=2, depth=2)
    models = learn.fit_models(cells, ["a", "b"], 8, 8, how).cache()
    assert models.count() == 2 and learn.check_features(models) == ["a", "b"]
    assert learn.importance(models).count() == 4
    fitted = learn.fitted_field(cells, models, ["a", "b"], 8, 8, how)
    assert fitted.count() == 128 and fitted.filter("test").count() == 2 * 13
    mask = cells.filter("month = 5").selectExpr("iy", "ix", "ix > 0 as inside")
    out = learn.predict(cells.filter("month = 5").select("iy", "ix", "a", "b"), models, mask, 8, 8, 6, 2)
    assert out.count() == 128 and out.filter("value is null").count() == 16
