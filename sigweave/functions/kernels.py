"""Numpy kernels on 2-D batches (rows: signals). No Spark here."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)


def welch(x: np.ndarray, fs: float, nperseg: int = 256, overlap: int = 128, window=hann, detrend: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided density spectra averaged over overlapping segments of each row."""
    n = min(nperseg, x.shape[1])
    step = n - min(overlap, n - 1)
    seg = np.lib.stride_tricks.sliding_window_view(x, n, axis=1)[:, ::step]
    if detrend:
        seg = seg - seg.mean(axis=2, keepdims=True)
    w = window(n)
    power = np.abs(np.fft.rfft(seg * w, axis=2)) ** 2 / (fs * (w**2).sum())
    power[:, :, 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power.mean(axis=1)


def band_integral(freqs: np.ndarray, psd: np.ndarray, bands) -> np.ndarray:
    """Trapezoid of each row's density over lo <= f < hi, by band; as a matrix product."""
    weights = np.zeros((len(freqs), len(bands)))
    for k, (lo, hi) in enumerate(bands):
        at = np.flatnonzero((freqs >= lo) & (freqs < hi))
        if len(at) > 1:
            gaps = np.diff(freqs[at])
            weights[at[:-1], k] += gaps / 2
            weights[at[1:], k] += gaps / 2
    return psd @ weights


def simpson(y: np.ndarray, dx: float) -> np.ndarray:
    """Composite Simpson's rule along rows; for an even number of points the last interval takes the
    parabola through the last three."""
    n = y.shape[1]
    if n < 3:
        return np.trapezoid(y, dx=dx, axis=1)
    m = n if n % 2 else n - 1
    out = dx / 3 * (y[:, 0] + y[:, m - 1] + 4 * y[:, 1 : m - 1 : 2].sum(axis=1) + 2 * y[:, 2 : m - 2 : 2].sum(axis=1))
    if m < n:
        out = out + dx * (5 * y[:, -1] / 12 + 2 * y[:, -2] / 3 - y[:, -3] / 12)
    return out


def fft_features(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Two-sided spectral features of each row: total, mean, median and peak."""
    half = np.abs(np.fft.rfft(x, axis=1)) ** 2
    power = np.concatenate([half, half[:, 1 : (x.shape[1] + 1) // 2][:, ::-1]], axis=1)  # both sides exactly alike, so a peak is at its positive side
    freqs = np.fft.fftfreq(x.shape[1], 1 / fs)
    total = power.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (freqs * power).sum(axis=1) / total
    return {"total_power": total, "mean_freq": mean, "median_freq": np.median(freqs * power, axis=1), "peak_freq": freqs[power.argmax(axis=1)]}


def analytic_envelope(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1))


def fourier_resample(x: np.ndarray, n: int) -> np.ndarray:
    """Rows resampled to ``n`` points by cutting or padding their spectra."""
    old = x.shape[1]
    spectrum = np.fft.rfft(x, axis=1)
    keep = min(n, old) // 2 + 1
    out = np.zeros((len(x), n // 2 + 1), complex)
    out[:, :keep] = spectrum[:, :keep]
    if min(n, old) % 2 == 0 and n != old:  # the middle bin stands for two, or half of one
        out[:, keep - 1] *= 2 if n < old else 0.5
    return np.fft.irfft(out, n, axis=1) * (n / old)


class ChirpGrid:
    """A transform of any ``period``, from values at 0 to ``have`` - 1 to bins 0 to ``want`` - 1, as a convolution with a
    chirp over a grid of n1 rows and n2 columns; column blocks are ``broad`` and row blocks ``tall``."""

    def __init__(self, period: int, have: int, want: int, chunk: int):
        bits = max(1, (have + want - 2).bit_length())
        self.period, self.have, self.want = period, have, want
        self.n1, self.n2 = 1 << bits // 2, 1 << bits - bits // 2
        self.broad, self.tall = min(self.n2, max(1, chunk // self.n1)), min(self.n1, max(1, chunk // self.n2))

    def chirp(self, q: np.ndarray) -> np.ndarray:
        """exp(i pi q^2 / period); q^2 is reduced as an integer, so large places lose nothing."""
        q = q % (2 * self.period)
        square = q * q if self.period < 1 << 30 else np.array([int(v) ** 2 % (2 * self.period) for v in q.ravel()]).reshape(q.shape)
        return np.exp(1j * np.pi / self.period * (square % (2 * self.period)))

    def places(self, block: int) -> np.ndarray:
        return np.arange(self.n1)[:, None] * self.n2 + np.arange(block * self.broad, (block + 1) * self.broad)

    def turn(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi / (self.n1 * self.n2) * (rows[:, None] * cols))

    def columns(self, block: int, at: np.ndarray, values: np.ndarray, of: np.ndarray | None = None, n: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The block's columns of the values and of the chirp, transformed along the columns and turned; of one signal,
        or of ``n``, with each value's own in ``of``."""
        a = np.zeros((self.n1, self.broad) if of is None else (n, self.n1, self.broad), complex)
        place = (at // self.n2, at % self.n2 - block * self.broad)
        a[place if of is None else (of, *place)] = values * self.chirp(at).conj()
        q, m = self.places(block), self.n1 * self.n2
        b = np.where((q < self.want) | (q > m - self.have), self.chirp(np.where(q < self.want, q, m - q)), 0)
        turn = self.turn(np.arange(self.n1), np.arange(block * self.broad, (block + 1) * self.broad))
        return np.fft.fft(a, axis=-2) * turn, np.fft.fft(b, axis=0) * turn

    def lines(self, block: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The block's rows of the product, transformed back along the rows and turned back."""
        turn = self.turn(np.arange(block * self.tall, (block + 1) * self.tall), np.arange(self.n2))
        return np.fft.ifft(np.fft.fft(a, axis=-1) * np.fft.fft(b, axis=-1), axis=-1) * turn.conj()

    def ends(self, block: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bins of the block's columns and their values."""
        q = self.places(block)
        kept = q < self.want
        return q[kept], np.fft.ifft(c, axis=-2)[..., kept] * self.chirp(q[kept]).conj()


def fir_taps(fs: float, low: float | None, high: float | None, stop: bool = False) -> np.ndarray:
    """Odd Hamming-windowed sinc taps; transitions of a quarter of the edge, at least 2 Hz and at most the edge."""
    nyquist = fs / 2
    gaps = ([min(max(0.25 * low, 2.0), low)] if low else []) + ([min(max(0.25 * high, 2.0), nyquist - high)] if high else [])
    n = int(np.ceil(3.3 / min(gaps) * fs))
    n += 1 - n % 2
    at = np.arange(n) - n // 2
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))

    def lowpass(edge: float) -> np.ndarray:
        h = 2 * edge / fs * np.sinc(2 * edge / fs * at) * window
        return h / h.sum()

    one = np.zeros(n)
    one[n // 2] = 1
    upper = lowpass(high + (-gaps[-1] if stop else gaps[-1]) / 2) if high else one
    lower = lowpass(low + (gaps[0] if stop else -gaps[0]) / 2) if low else np.zeros(n)
    passed = upper - lower
    return one - passed if stop else passed


def notch_taps(fs: float, freq: float, width: float, transition: float = 1.0) -> np.ndarray:
    """Taps of a band stop of ``width`` around ``freq``."""
    n = int(np.ceil(3.3 / transition * fs))
    n += 1 - n % 2
    at = np.arange(n) - n // 2
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))

    def lowpass(edge: float) -> np.ndarray:
        h = 2 * edge / fs * np.sinc(2 * edge / fs * at) * window
        return h / h.sum()

    out = lowpass(freq - (width + transition) / 2) - lowpass(freq + (width + transition) / 2)
    out[n // 2] += 1
    return out


def reflect(x: np.ndarray, lead: int, tail: int) -> np.ndarray:
    """``x`` (or each of its rows) led and followed by itself, turned around its end points; as far as it reaches, then constant."""
    n = x.shape[-1]
    a, b = min(lead, n - 1), min(tail, n - 1)
    head = 2 * x[..., :1] - x[..., a:0:-1]
    foot = 2 * x[..., -1:] - x[..., -2 : -b - 2 : -1] if b else x[..., :0]
    out = np.concatenate([head, x, foot], axis=-1)
    return np.pad(out, [(0, 0)] * (x.ndim - 1) + [(lead - a, tail - b)], mode="edge") if (lead > a or tail > b) else out


def fft_convolve(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Rows convolved with symmetric ``taps``; same length, centred, zeros outside."""
    n = x.shape[1] + len(taps) - 1
    size = 1 << (n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size, axis=1) * np.fft.rfft(taps, size), size, axis=1)
    half = len(taps) // 2
    return full[:, half : half + x.shape[1]]


def butterworth_sections(fs: float, low: float, high: float, order: int) -> np.ndarray:
    """Second-order sections [order, (gain, a1, a2)] of a Butterworth band-pass: (gain - gain z^-2) / (1 + a1 z^-1 + a2 z^-2) each."""
    lo, hi = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = proto * (hi - lo) / 2
    root = np.sqrt(half**2 - lo * hi + 0j)
    s = np.concatenate([half + root, half - root])
    z = (1 + s) / (1 - s)
    turning, real = z[z.imag > 1e-12], np.sort(z[np.abs(z.imag) <= 1e-12].real)
    poles = [(-2 * p.real, abs(p) ** 2) for p in turning] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    poles.sort(key=lambda p: p[1])  # poles near the circle last
    at = np.exp(-2j * np.arctan(np.sqrt(lo * hi)))  # the band's centre
    return np.array([(abs((1 + a1 * at + a2 * at**2) / (1 - at**2)), a1, a2) for a1, a2 in poles])


def cascade(sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """State-space form (A, B, C, D) of sections in a row, two states each."""
    n = 2 * len(sections)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (g, a1, a2) in enumerate(sections):
        own = slice(2 * k, 2 * k + 2)
        inside, enter = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([-a1 * g, -g - a2 * g])
        a[own, own] = inside
        a[own, : 2 * k] = np.outer(enter, c[: 2 * k])
        b[own] = enter * d
        c, d = c * g, d * g
        c[2 * k] += 1
    return a, b, c, d


class SectionFilter:
    """A cascade of sections run over blocks: within blocks by matrices, across them by the state."""

    def __init__(self, sections: np.ndarray, block: int = 64):
        a, b, c, d = cascade(sections)
        self.block, self.order = block, len(b)
        self.a = a
        powers = [np.eye(self.order)]
        for _ in range(block):
            powers.append(a @ powers[-1])
        self.over = powers[block]
        self.out = np.stack([c @ p for p in powers[:block]])  # of the state at a block's begin, on its outputs
        self.into = np.stack([p @ b for p in powers[block - 1 :: -1]], axis=1)  # of a block's inputs, on the state at its end
        response = np.concatenate([[d], [c @ p @ b for p in powers[: block - 1]]])
        lag = np.subtract.outer(np.arange(block), np.arange(block))
        self.inside = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
        self.rest = np.zeros(self.order)  # the state, for an input of one for ever, at rest
        self.rest[:2] = -sections[0][0]

    def states(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """States at the begin of each whole block, and at the end of ``x`` (or of each of its rows)."""
        n = x.shape[-1]
        m = n // self.block
        enter = x[..., : m * self.block].reshape(*x.shape[:-1], m, self.block) @ self.into.T
        held = np.empty((m + 2, *x.shape[:-1], self.order))
        held[0] = state
        for i in range(m):
            held[i + 1] = held[i] @ self.over.T + enter[..., i, :]
        r = n - m * self.block
        held[m + 1] = held[m] @ np.linalg.matrix_power(self.a, r).T + x[..., n - r :] @ self.into[:, self.block - r :].T
        return held

    def end(self, x: np.ndarray) -> np.ndarray:
        """The state behind ``x``, from a state of zeros."""
        return self.states(x, np.zeros(self.order))[-1]

    def run(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        held = self.states(x, state)
        n = x.shape[-1]
        m = n // self.block
        r = n - m * self.block
        whole = x[..., : m * self.block].reshape(*x.shape[:-1], m, self.block) @ self.inside.T + np.moveaxis(held[:m] @ self.out.T, 0, -2)
        last = x[..., n - r :] @ self.inside[:r, :r].T + held[m] @ self.out[:r].T
        return np.concatenate([whole.reshape(*x.shape[:-1], m * self.block), last], axis=-1)

    def there_and_back(self, x: np.ndarray) -> np.ndarray:
        """Rows filtered forward and then backward, each way from a state at rest."""
        for _ in range(2):
            x = self.run(x, x[..., :1] * self.rest)[..., ::-1]
        return x

    def free(self, n: int) -> np.ndarray:
        """[state, place]: ``n`` outputs without input, from each state of one."""
        return self.run(np.zeros((self.order, n)), np.eye(self.order))


def multitaper_power(x: np.ndarray, fs: float, freqs: np.ndarray, n_tapers: int = 3) -> np.ndarray:
    """Time-frequency power [row, frequency, time]: sine-tapered complex exponentials of f / 2 cycles, convolved by FFT."""
    out = np.zeros((len(x), len(freqs), x.shape[1]))
    for k, f in enumerate(freqs):
        length = max(3, int(round(0.5 * fs)))  # f / 2 cycles last half a second
        t = (np.arange(length) - length / 2) / fs
        for taper in range(1, n_tapers + 1):
            w = np.sin(np.pi * taper * (np.arange(length) + 1) / (length + 1)) * np.exp(2j * np.pi * f * t)
            w /= np.sqrt((np.abs(w) ** 2).sum())
            size = x.shape[1] + length - 1
            conv = np.fft.ifft(np.fft.fft(x, size, axis=1) * np.fft.fft(w, size), axis=1)
            out[:, k] += np.abs(conv[:, length // 2 : length // 2 + x.shape[1]]) ** 2
    return out / n_tapers


def refractory(times: np.ndarray, gap: float, last: float = -np.inf) -> np.ndarray:
    """Which of the sorted ``times`` are accepted: each more than ``gap`` after the last accepted one, ``last`` at first."""
    accepted = np.zeros(len(times), bool)
    at = int(np.searchsorted(times, last + gap, side="right"))
    while at < len(times):
        accepted[at] = True
        last = times[at]
        at = int(np.searchsorted(times, last + gap, side="right"))
    return accepted


def refractory_steps(times: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """The last accepted of the sorted ``times``, as a step function of the last one accepted before all of them:
    for ``last``, that of the first step whose ``upto`` is above last + gap; past the steps, none is accepted."""
    n = len(times)
    after = np.searchsorted(times, times + gap, side="right")
    end = np.where(after < n, after, np.arange(n))
    while not np.array_equal(end, end[end]):  # jumps twice as far each time
        end = end[end]
    first = min(int(np.searchsorted(times, times[0] + gap, side="right")), n - 1)  # no later one can be accepted first
    upto, last = times[: first + 1], times[end[: first + 1]]
    edge = np.append(last[1:] != last[:-1], True)
    return upto[edge], last[edge]


def ledoit_wolf(n: int, scatter: np.ndarray, fourth: float) -> np.ndarray:
    """Shrunk covariance from centred sums: ``scatter`` = sum of x x^T, ``fourth`` = sum of |x|^4."""
    p = len(scatter)
    cov = scatter / n
    mu = np.trace(cov) / p
    delta = ((cov - mu * np.eye(p)) ** 2).sum() / p
    beta = min(max((fourth / n - (cov**2).sum()) / (n * p), 0.0), delta)
    shrink = beta / delta if delta else 0.0
    return (1 - shrink) * cov + shrink * mu * np.eye(p)


def lda_from_sums(priors: np.ndarray, means: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights [class, feature] and offsets of linear discriminant scores, by least squares."""
    coef = np.linalg.lstsq(cov, means.T, rcond=None)[0].T
    return coef, -0.5 * (means * coef).sum(axis=1) + np.log(priors)


def csp_filters(c1: np.ndarray, c2: np.ndarray, n: int) -> np.ndarray:
    """Spatial filters [n, channel]: generalised eigenvectors of (c1, c1 + c2), farthest from one half first."""
    d, u = np.linalg.eigh(c1 + c2)
    white = (u / np.sqrt(np.maximum(d, 1e-12))).T
    w, v = np.linalg.eigh(white @ c1 @ white.T)
    order = np.argsort(-np.abs(w - 0.5))[:n]
    return v[:, order].T @ white


def infomax_step(weights: np.ndarray, bias: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (1 - 2 sigmoid(u)) u^T and of (1 - 2 sigmoid(u)) over rows of whitened ``x``."""
    u = x @ weights.T + bias
    y = 1 - 2 / (1 + np.exp(-np.clip(u, -500, 500)))
    return y.T @ u, y.sum(axis=0)
