import numpy as np
import pytest

from quadfield import basis


@pytest.mark.parametrize("n", range(2, 17))
def test_quadrature_is_exact_to_degree_2n_minus_3(n):
    x, w = basis.nodes(n), basis.weights(n)
    assert abs(w.sum() - 2.0) < 1e-13
    for k in range(2 * n - 2):
        assert abs(w @ x ** k - (0.0 if k % 2 else 2.0 / (k + 1))) < 1e-12


@pytest.mark.parametrize("n", [3, 6, 9])
def test_interpolation_reproduces_polynomials(n):
    t = np.linspace(-1, 1, 37)
    p = np.polynomial.Polynomial(np.arange(1, n + 1) / n)
    assert np.abs(basis.lagrange(n, t) @ p(basis.nodes(n)) - p(t)).max() < 1e-12
    assert np.abs(basis.lagrange(n, basis.nodes(n)) - np.eye(n)).max() < 1e-13


def test_derivative_matrix():
    x, p = basis.nodes(8), np.polynomial.Polynomial([1, -2, 0.5, 3, 0, -1, 2, 1])
    assert np.abs(basis.derivative_matrix(8) @ p(x) - p.deriv()(x)).max() < 1e-11


def test_modes_invert_the_vandermonde():
    assert np.abs(basis.modal_matrix(8) @ basis.vandermonde(8) - np.eye(8)).max() < 1e-12


def test_targets():
    assert np.allclose(basis.cell_centres(4), [-0.75, -0.25, 0.25, 0.75])
    with pytest.raises(ValueError):
        basis.resample_matrix(4, 3, "other")
    with pytest.raises(ValueError):
        basis.nodes(1)
