"""DuckDB SQL of the window metrics over 64 x 64 images ``t`` (img, r, c, a, b, f)."""

from __future__ import annotations

from lumenfuse.operators import similarity as S

_FUSED, _ALL = S.SOURCES_TO_FUSED, S.ALL_PRODUCTS


def _taps(name: str, n: int, sigma: float) -> str:
    return f"{name} as (select i::int as i, e / sum(e) over () as t from (select i, exp(-pow(i - {(n - 1) / 2}, 2) / {2 * sigma * sigma}) as e from range({n}) q(i)))"


def _window(name: str, source: str, taps: str, n: int, side: int, products: tuple[str, ...], plain: tuple[str, ...] = (), step: int = 1) -> str:
    """CTEs ``name_c`` and ``name``: weighted sums of channels and products in windows that fit, as two passes."""
    first = f"(select img, r, c, a, b, f{''.join(f', {p[0]} * {p[1]} as {p}' for p in products)} from {source})"
    sums = ", ".join(f"sum({v} * t) as {v}" for v in ("a", "b", "f", *products))
    flat = lambda raw: "".join(f", sum({p if raw else 'sum_' + p}) as sum_{p}" for p in plain)
    fits = lambda x: f"{x} >= i and {x} - i <= {side - n} and ({x} - i) % {step} = 0"
    return f"{name}_c as (select img, r, (c - i) // {step} as c, {sums}{flat(True)} from {first} x, {taps} where {fits('c')} group by img, r, (c - i) // {step}), {name} as (select img, (r - i) // {step} as r, c, {sums}{flat(False)} from {name}_c x, {taps} where {fits('r')} group by img, c, (r - i) // {step})"


def _cov(x: str, y: str) -> str:
    e, d = "".join(sorted(x + y)), f"({''.join(sorted(x + y))} - {x} * {y})"
    return f"(case when abs({d}) <= {S.ROUNDING} * abs({e}) then 0 else {d} end)"


def _ssim(x: str, y: str, c1: float, c2: float) -> str:
    return f"((2 * {x} * {y} + {c1}) * (2 * {_cov(x, y)} + {c2}) / (({x} * {x} + {y} * {y} + {c1}) * ({_cov(x, x)} + {_cov(y, y)} + {c2})))"


def _ssim_parts() -> list[str]:
    wide = "wide as (select img, r::int as r, c::int as c, a, b, f from (select img, y.i as r, x.i as c, a, b, f from t join range(74) y(i) on t.r = least(63, greatest(0, y.i - 5)) join range(74) x(i) on t.c = least(63, greatest(0, x.i - 5))))"
    return [wide, _window("w_ssim", "wide", "g11", 11, 74, _FUSED), f'm_ssim as (select img, (avg({_ssim("f", "a", 1e-4, 9e-4)}) + avg({_ssim("f", "b", 1e-4, 9e-4)})) / 2 as "SSIM" from w_ssim group by img)']


def _information_parts() -> list[str]:
    parts, source, side = [], "t", 64
    for k, n in enumerate((17, 9, 5, 3)):
        parts.append(_taps(f"g_v{k}", n, n / 5))
        if k:
            parts.append(_window(f"scale{k}", source, f"g_v{k}", n, side, (), step=2))
            source, side = f"scale{k}", (side - n) // 2 + 1
        v = {x: f"greatest({_cov(x, x)}, 0)" for x in "abf"}
        parts += [_window(f"w_v{k}", source, f"g_v{k}", n, side, _FUSED), f"n_v{k} as (select img, {v['f']} as vf, {', '.join(f'{v[x]} as v{x}, {_cov(x, chr(102))} as k{x}' for x in 'ab')} from w_v{k})"]
        gain = ", ".join(f"case when v{x} < {S.FLAT} or vf < {S.FLAT} then 0 else k{x} / (v{x} + {S.FLAT}) end as g{x}" for x in "ab")
        rest = ", ".join(f"greatest({S.FLAT}, case when vf < {S.FLAT} then 0 when v{x} < {S.FLAT} or g{x} < 0 then vf else vf - g{x} * k{x} end) as e{x}, greatest(g{x}, 0) as g{x}, case when v{x} < {S.FLAT} then 0 else v{x} end as v{x}" for x in "ab")
        parts.append(f"o_v{k} as (select img, {k} as k, {rest} from (select *, {gain} from n_v{k}))")
    top = lambda x, noise: f"log10(1 + g{x} * g{x} * v{x} / (e{x} + {noise}))"
    low = lambda x, noise: f"log10(1 + v{x} / {noise})"
    either = lambda p: f"sum(case when ga < gb then {p('a', S.VIFF_NOISE)} else {p('b', S.VIFF_NOISE)} end + {S.VIFF_GUARD})"
    sums = ", ".join(f"sum({top(x, S.VIF_NOISE)}) as t{x}, sum({low(x, S.VIF_NOISE)}) as l{x}" for x in "ab")
    parts.append(f"s_v as (select img, k, {sums}, {either(top)} / {either(low)} as s from ({' union all '.join(f'select * from o_v{k}' for k in range(4))}) group by img, k)")
    weights = ", ".join(str(w / sum(S.VIFF_WEIGHTS)) for w in S.VIFF_WEIGHTS)
    return [*parts, f'm_vif as (select img, sum(ta) / sum(la) + sum(tb) / sum(lb) as "VIF", sum(s * [{weights}][k + 1]) as "VIFF" from s_v group by img)']


def _multi_scale_parts(loose: bool) -> list[str]:
    name, parts, source, side = "l" if loose else "s", [], "t", 64
    small, n = (1e-10 if loose else S.EPS), S.SIZE**2
    plain = lambda x, y: f"(({n} * sum_{x}{y} - sum_{x} * sum_{y}) / {n})"
    root = lambda x: f"sqrt(greatest(0, {x}))"
    both = lambda k: f"(pa * pa * {k}aa + 2 * pa * pb * {k}ab + pb * pb * {k}bb)"
    for k in range(3):
        if k:  # even sides: the pixel before the first is the first, and the last one is not used
            at = (lambda x: f"({x} + 1) // 2") if loose else (lambda x: f"{x} // 2")
            twice = (lambda x: f"case when {x} = 0 then 2 else 1 end") if loose else (lambda x: "1")
            parts.append(f"h_{name}{k} as (select img, {at('r')} as r, {at('c')} as c, {', '.join(f'sum({v} * {twice(chr(114))} * {twice(chr(99))}) / 4 as {v}' for v in 'abf')} from {source} where {at('r')} < {side // 2} and {at('c')} < {side // 2} group by img, {at('r')}, {at('c')})")
            source, side = f"h_{name}{k}", side // 2
        w = f"w_{name}{k}"
        parts.append(_window(w, source, "g11", 11, side, _ALL, ("a", "b", "aa", "bb", "ab")))
        raw = f"select img, {', '.join(f'{plain(*p)} as u{p}' for p in ('aa', 'ab', 'bb'))}, {', '.join(f'{_cov(*p)} as k{p}' for p in _ALL)} from {w}"
        ratio = f"({root('uaa + 2 * uab + ubb')} + {small}) / ({root('uaa')} + {root('ubb')} + {small})"
        kept = f"least(1 - {small}, greatest({small}, {ratio}))" if loose else f"case when {ratio} > 1 then 1 - {small} else {ratio} end"
        power = f"select *, least({S.MOST}, tan(pi() / 2 * ({kept}))) as p, {root('uaa')} + 0.001 as ea, {root('ubb')} + 0.001 as eb from ({raw})"
        weight = f"select *, pow(ea / {S.SIZE}, p) + {0 if loose else S.EPS} as wa, pow(eb / {S.SIZE}, p) + {0 if loose else S.EPS} as wb from ({power})"
        guard = small if loose else 0
        share = f"select *, wa / (wa + wb + {guard}) / (ea + {guard}) as pa, wb / (wa + wb + {guard}) / (eb + {guard}) as pb from ({weight})"
        scale = f"select *, coalesce(greatest(ea, eb) / nullif({root(both('u'))}, 0), 1) as s from ({share})"
        parts.append(f"q_{name}{k} as (select img, avg((2 * s * (pa * kaf + pb * kbf) + {S.MS_C}) / (s * s * {both('k')} + kff + {S.MS_C})) as q from ({scale}) group by img)")
    score = " * ".join(f"pow({'greatest(0, ' if loose else '('}q_{name}{k}.q), {w / sum(S.MS_WEIGHTS)})" for k, w in enumerate(S.MS_WEIGHTS))
    return [*parts, f'm_{name} as (select img, {score} as "MS_SSIM{"_loose" if loose else ""}" from q_{name}0 join q_{name}1 using (img) join q_{name}2 using (img))']


def _saliency_parts() -> list[str]:
    diffs = ", ".join(f"sqrt(pow(sum({v} * -j), 2) + pow(sum({v} * -i), 2)) as {v}" for v in "abf")
    edges = f"edges as (select img, r - i as r, c - j as c, {diffs} from t, (select unnest([-1, 0, 1]) as i) y, (select unnest([-1, 0, 1]) as j) x where r - i between 0 and 63 and c - j between 0 and 63 group by img, r - i, c - j)"
    c1, c2, parts = (0.01 * 255) ** 2, (0.03 * 255) ** 2, [edges]
    for name, source in (("p", "t"), ("e", "edges")):
        flat = f"case when {_cov('a', 'a')} + {_cov('b', 'b')} = 0 then 0.5 else 0 end"
        inner = f"select img, {_cov('a', 'a')} + {flat} as va, {_cov('b', 'b')} + {flat} as vb, {_ssim('f', 'a', c1, c2)} as qa, {_ssim('f', 'b', c1, c2)} as qb from w_q{name}"
        parts += [_window(f"w_q{name}", source, "g11", 11, 64, _FUSED), f"n_q{name} as (select img, avg(q) as q, sum(w * q) / sum(w) as qw from (select img, (va * qa + vb * qb) / (va + vb) as q, greatest(va, vb) as w from ({inner})) group by img)"]
    return [*parts, 'm_q as (select img, n_qp.q as "Q", n_qp.qw as "Qw", n_qe.qw * n_qe.qw as "Qe" from n_qp join n_qe using (img))']


def _agreement_parts() -> list[str]:
    ratio = lambda x, y: f"coalesce(({x}) / nullif(({x}) + ({y}), 0), 'nan'::double)"
    q = ", ".join(f"{_ssim(*p, S.TINY, S.TINY)} as q{p}" for p in ("ab", "af", "bf"))
    inner = f"select img, {q}, {ratio(_cov('a', 'a'), _cov('b', 'b'))} as v, {ratio(_cov('a', 'f'), _cov('b', 'f'))} as k from w_y"
    blend = lambda x: f"{x} * qaf + (1 - {x}) * qbf"
    qc = f"case when isnan(k) then k when k < 0 then 0 when k > 1 then 1 else {blend('k')} end"
    return [_taps("g7", 7, 1.5), _window("w_y", "t", "g7", 7, 64, _ALL), f'm_y as (select img, avg(case when qab >= {S.AGREE} then {blend("v")} else greatest(qaf, qbf) end) as "QY", avg({qc}) as "QC" from ({inner}) group by img)']


def all_scores() -> str:
    """CTEs from ``t`` to ``scores`` (img and every window metric)."""
    parts = [_taps("g11", 11, 1.5), *_ssim_parts(), *_multi_scale_parts(False), *_multi_scale_parts(True), *_information_parts(), *_saliency_parts(), *_agreement_parts()]
    return ", ".join(parts) + ", scores as (select * from m_ssim join m_s using (img) join m_l using (img) join m_vif using (img) join m_q using (img) join m_y using (img))"
