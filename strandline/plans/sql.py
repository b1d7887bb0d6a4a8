"""DuckDB SQL of the queries whose text is long: iterations unrolled, exact tests by log gamma, walks by small matrices."""

from __future__ import annotations

from strandline.functions.special import erfc_sql, t_p_sql

W = "OVER (PARTITION BY locus)"


def tail(x: str) -> str:
    """Upper tail of chi-square with one degree of freedom."""
    return f"least({erfc_sql(f'sqrt(({x})/2e0)')},1e0)"


def two_sided(z: str) -> str:
    return f"least({erfc_sql(f'(abs({z})/{2**0.5!r}e0)')},1e0)"


def md5_number(text: str, digits: int = 13) -> str:
    return f"CAST(concat('0x', substr(md5({text}),1,{digits})) AS BIGINT)"


def fisher(a: str, b: str, c: str, d: str) -> str:
    """Two-sided Fisher p of whole numbers."""
    log = lambda x: f"(-lgamma({x}+1)-lgamma(({a}+{b})-{x}+1)-lgamma(({a}+{c})-{x}+1)-lgamma(({c}+{d})-({a}+{c})+{x}+1))"
    const = f"(lgamma({a}+{b}+1)+lgamma({c}+{d}+1)+lgamma({a}+{c}+1)+lgamma({b}+{d}+1)-lgamma({a}+{b}+{c}+{d}+1))"
    xs = f"range(greatest(0,({a}+{c})-({c}+{d})), least({a}+{b},{a}+{c})+1)"
    return f"least(list_sum(list_transform({xs}, lambda x: CASE WHEN {log('x')}<={log(a)}+1e-7 THEN exp({log('x')}+{const}) ELSE 0 END)),1e0)"


ADJUSTED = f"""WITH k AS (SELECT count(*)*1e0 AS n, sum(population)*1e0 AS sx, sum(population*population)*1e0 AS sxx, sum(y) AS sy, sum(population*y) AS sxy, sum(y*y) AS syy FROM sample),
c AS (SELECT *, n*sxx-sx*sx AS det, (sxx*sy-sx*sxy)/(n*sxx-sx*sx) AS b0, (n*sxy-sx*sy)/(n*sxx-sx*sx) AS b1 FROM k),
m AS (SELECT v, sum(g*g)*1e0 AS gg, sum(g*y) AS gy, sum(g)*1e0 AS g0, sum(g*population)*1e0 AS g1 FROM genotype JOIN sample USING (s) GROUP BY v),
r AS (SELECT v, n, gg-(g0*g0*sxx-2*g0*g1*sx+g1*g1*n)/det AS rgg, gy-(g0*b0+g1*b1) AS rgy, syy-(b0*sy+b1*sxy) AS ryy FROM m, c),
f AS (SELECT v, n, rgy/rgg AS beta, sqrt(greatest(ryy-rgy/rgg*rgy,0)/(n-3)/rgg) AS se FROM r)
SELECT v, CAST(n AS INT) AS n, round(beta,6) AS beta, round(se,6) AS se, round(beta/se,6) AS t, round({t_p_sql('beta/se', '(n-3)')},6) AS p_value FROM f"""

HARDY = """, h AS (SELECT v, ctrl_het AS het, least(ctrl_ha,ctrl_hr) AS aa, ctrl_hr+ctrl_het+ctrl_ha AS n,
  least(2*case_ha+case_het, 2*(case_hr+case_het+case_ha)-2*case_ha-case_het)+least(2*ctrl_ha+ctrl_het, 2*(ctrl_hr+ctrl_het+ctrl_ha)-2*ctrl_ha-ctrl_het) AS mac FROM counts),
mi AS (SELECT *, least(2*aa+het, 2*n-2*aa-het) AS minor FROM h),
lg AS (SELECT *, list_transform(range(minor%2, minor+1, 2), lambda k: k*ln(2)-lgamma((minor-k)/2+1)-lgamma(k+1)-lgamma(n-k-(minor-k)/2+1)) AS logs,
  het*ln(2)-lgamma((minor-het)/2+1)-lgamma(het+1)-lgamma(n-het-(minor-het)/2+1) AS seen FROM mi),
ex AS (SELECT *, list_transform(logs, lambda x: exp(x-list_max(logs))) AS e, exp(seen-list_max(logs))*(1+1e-9) AS s FROM lg),
p AS (SELECT v, mac, least(list_sum(list_transform(e, lambda x: CASE WHEN x<=s THEN x ELSE 0 END))/list_sum(e),1) AS p FROM ex)
SELECT v, round(p,6) AS hwe_pvalue_controls, mac>=5 AND p>=1e-10 AS passed FROM p"""


def _newton(name: str, free: bool) -> str:
    """50 damped steps of the penalised logistic fit to 2x3 counts, both coefficients free or the intercept alone."""
    r = lambda j: f"(y{j}-n{j}*p{j}+n{j}*p{j}*(1-p{j})*(s2-2*s1*{j}+s0*{j * j})/det*(0.5-p{j}))"
    p = ", ".join(f"1/(1+exp(-least(greatest(b0+b1*{j},-35),35))) AS p{j}" for j in range(3))
    s = [" + ".join(f"n{j}*p{j}*(1-p{j})*{j**k}" for j in range(3)) for k in range(3)]
    step0 = "(s2*u0-s1*u1)/det" if free else "u0/s0"
    step1 = "(s0*u1-s1*u0)/det" if free else "0e0"
    clip = lambda x: f"least(greatest({x},-2),2)"
    return f"""{name}(v,k,b0,b1,y0,y1,y2,n0,n1,n2) AS (SELECT v, 0, ln(rate/(1-rate)), 0e0, y0,y1,y2,n0,n1,n2 FROM (SELECT *, least(greatest((y0+y1+y2)/(n0+n1+n2),1e-6),1-1e-6) AS rate FROM cells)
 UNION ALL SELECT v, k+1, b0+{clip(step0)}, b1+{clip(step1)}, y0,y1,y2,n0,n1,n2 FROM (SELECT *, {r(0)}+{r(1)}+{r(2)} AS u0, {r(1)}+2*{r(2)} AS u1 FROM
  (SELECT *, s0*s2-s1*s1 AS det FROM (SELECT *, {s[0]} AS s0, {s[1]} AS s1, {s[2]} AS s2 FROM (SELECT *, {p} FROM {name} WHERE k<50)))))"""


def _likelihood(name: str) -> str:
    p = ", ".join(f"1/(1+exp(-least(greatest(b0+b1*{j},-35),35))) AS p{j}" for j in range(3))
    s = [" + ".join(f"n{j}*p{j}*(1-p{j})*{j**k}" for j in range(3)) for k in range(3)]
    ll = " + ".join(f"y{j}*ln(p{j})+(n{j}-y{j})*ln(1-p{j})" for j in range(3))
    return f"(SELECT v, b1, sqrt(s0/(s0*s2-s1*s1)) AS se, {ll}+0.5*ln(s0*s2-s1*s1) AS l FROM (SELECT *, {s[0]} AS s0, {s[1]} AS s1, {s[2]} AS s2 FROM (SELECT *, {p} FROM {name} WHERE k=50)))"


LOCI = f""", me AS (SELECT *, CAST(least(least(a,b),least(c,d)) AS BIGINT) AS mac, CASE WHEN least(least(a,b),least(c,d))>=20 AND least(case_hr,case_het,case_ha,ctrl_hr,ctrl_het,ctrl_ha)>=5 THEN 'chi2' WHEN least(least(a,b),least(c,d))>=5 THEN 'firth' ELSE 'fisher' END AS method FROM allelic),
x2 AS (SELECT v, method, mac, CASE WHEN a*b*c*d>0 THEN ln(a*d/(b*c)) ELSE 0 END AS beta, CASE WHEN a*b*c*d>0 THEN sqrt(1/a+1/b+1/c+1/d) END AS se, CASE WHEN a*b*c*d>0 THEN a*d/(b*c) ELSE 1 END AS odds_ratio,
  CASE WHEN (a+b)*(c+d)*(a+c)*(b+d)>0 THEN (a+b+c+d)*power(greatest(abs(a*d-b*c)-(a+b+c+d)/2,0),2)/((a+b)*(c+d)*(a+c)*(b+d)) ELSE 0 END AS x FROM me WHERE method='chi2'),
cells AS (SELECT v, CAST(case_hr AS DOUBLE) AS y0, CAST(case_het AS DOUBLE) AS y1, CAST(case_ha AS DOUBLE) AS y2, CAST(case_hr+ctrl_hr AS DOUBLE) AS n0, CAST(case_het+ctrl_het AS DOUBLE) AS n1, CAST(case_ha+ctrl_ha AS DOUBLE) AS n2 FROM me WHERE method='firth'),
{_newton('fu', True)}, {_newton('nu', False)},
fi AS (SELECT f.v, f.b1 AS beta, f.se, greatest(2*(f.l-z.l),0) AS x FROM {_likelihood('fu')} f JOIN {_likelihood('nu')} z USING (v)),
ex AS (SELECT v, method, mac, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, CASE WHEN b*c>0 THEN a*d/(b*c) ELSE 'inf'::DOUBLE END AS odds_ratio FROM me WHERE method='fisher'),
al AS (SELECT v, method, mac, beta, se, odds_ratio, {tail('x')} AS p FROM x2 UNION ALL SELECT v, method, mac, beta, se, exp(beta), {tail('x')} FROM fi JOIN me USING (v)
 UNION ALL SELECT v, method, mac, CASE WHEN odds_ratio>0 AND odds_ratio<'inf'::DOUBLE THEN ln(odds_ratio) ELSE 0 END, NULL, odds_ratio, {fisher('a', 'b', 'c', 'd')} FROM ex)
SELECT v, method, mac, round(beta,6) AS beta, round(se,6) AS se, round(odds_ratio,6) AS odds_ratio, round(p,6) AS p_value, round(CASE WHEN p>0 THEN -log10(p) ELSE 300 END,6) AS p_value_log10 FROM al"""

#: Shortest paths of small graphs by all simple paths: e(locus, a, b, w).
_PATHS = """sy AS (SELECT locus,a,b,w FROM e UNION ALL SELECT locus,b,a,w FROM e),
pa(locus,s,t,len,path) AS (SELECT locus,a,b,w,[a,b] FROM sy UNION ALL SELECT pa.locus,s,sy.b,len+sy.w,list_append(path,sy.b) FROM pa JOIN sy ON sy.locus=pa.locus AND sy.a=pa.t WHERE NOT list_contains(path,sy.b)),
di AS (SELECT locus,s,t,min(len) AS d FROM pa GROUP BY ALL), sp AS (SELECT pa.* FROM pa JOIN di USING (locus,s,t) WHERE len<=d+1e-15), ways AS (SELECT locus,s,t,count(*) AS k FROM sp GROUP BY ALL),
mid AS (SELECT sp.locus, s, t, unnest(path[2:len(path)-1]) AS v FROM (SELECT locus,s,t,path FROM sp) sp), nodes AS (SELECT locus,a AS v,count(*) OVER (PARTITION BY locus) AS n FROM (SELECT DISTINCT locus,a FROM sy)),
bt AS (SELECT nodes.locus, nodes.v, coalesce(x,0)*CASE WHEN n>2 THEN 1e0/((n-1)*(n-2)) ELSE 1 END AS score FROM nodes LEFT JOIN (SELECT locus, v, sum(1e0/k) AS x FROM mid JOIN ways USING (locus,s,t) GROUP BY ALL) USING (locus,v))"""

CENTRALITY = f""", e AS (SELECT gene AS locus, v1 AS a, v2 AS b, r*r AS w FROM ld JOIN variant ON v=v1 WHERE r*r>=0.3), {_PATHS}
SELECT locus, v, round(score,6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY locus ORDER BY round(score,12) DESC, v) AS INT) AS rank FROM bt) WHERE rank<=10"""

PRUNED = """, w AS (SELECT v, beta, {p} AS p FROM run_a WHERE {p}<0.2), e AS (SELECT 0 AS locus, v1 AS a, v2 AS b, 1e0 AS w FROM ld WHERE r*r>=0.2 AND v1 IN (SELECT v FROM w) AND v2 IN (SELECT v FROM w)),
re(v,c) AS (SELECT v, v FROM w UNION SELECT x.v, re.c FROM re JOIN (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e) x ON x.u=re.v), co AS (SELECT v, min(c) AS locus FROM re GROUP BY v),
es AS (SELECT co.locus, a, b, w FROM e JOIN co ON co.v=a), {paths}
SELECT v, round(beta,6) AS beta, round(p,6) AS p_value FROM (SELECT w.*, row_number() OVER (PARTITION BY co.locus ORDER BY round(coalesce(score,0),12) DESC, p, w.v) AS k FROM w JOIN co USING (v) LEFT JOIN bt ON bt.v=w.v) WHERE k=1""".format(p="{p}", paths=_PATHS.replace("FROM e ", "FROM es ").replace("FROM e)", "FROM es)"))


def _belief(last: int = 5, alpha: float = 0.6) -> str:
    out = f"""hh AS (SELECT *, exp(uq-max(uq) {W}) AS e0 FROM uq WHERE cnt>=3), r0 AS (SELECT locus, v, e0/sum(e0) {W} AS soft, e0/sum(e0) {W} AS b, 0e0 AS prior FROM hh),
vg AS (SELECT locus, v, gene AS g FROM hh JOIN variant USING (v)), gp AS (SELECT DISTINCT locus, g, pathway AS p FROM vg JOIN gene_pathway ON gene_pathway.gene=g),
bo AS (SELECT a,b FROM ppi UNION SELECT b,a FROM ppi), gg AS (SELECT DISTINCT x.locus, x.g, y.g AS h FROM vg x JOIN bo ON a=x.g JOIN vg y ON y.locus=x.locus AND y.g=b),
pd AS (SELECT DISTINCT locus, g, g AS f, CASE WHEN locus IN (SELECT locus FROM gg) THEN 0.7e0 ELSE 1e0 END AS x FROM vg UNION ALL SELECT locus, g, h, 0.3e0/count(*) OVER (PARTITION BY locus,g) FROM gg),
sh AS (SELECT x.locus, x.g, y.g AS h, count(*) AS k FROM gp x JOIN gp y USING (locus,p) GROUP BY ALL), ke AS (SELECT sh.locus, sh.g, pd.f, sum(k*x) AS k FROM sh JOIN pd ON pd.locus=sh.locus AND pd.g=sh.h GROUP BY ALL),
mm AS (SELECT ke.locus, x.v, y.v AS u, sum(k) AS m FROM ke JOIN vg x ON x.locus=ke.locus AND x.g=ke.g JOIN vg y ON y.locus=ke.locus AND y.g=ke.f GROUP BY ALL)"""
    for k in range(1, last + 1):
        out += f""",
w{k} AS (SELECT r.locus, r.v, r.soft, r.b, coalesce(sum(m*o.b),0) AS raw FROM r{k - 1} r LEFT JOIN mm ON mm.v=r.v AND mm.locus=r.locus LEFT JOIN r{k - 1} o ON o.v=mm.u AND o.locus=mm.locus GROUP BY r.locus, r.v, r.soft, r.b),
x{k} AS (SELECT *, CASE WHEN sum(raw) {W}>0 THEN raw/sum(raw) {W} ELSE raw END AS prior FROM w{k}), y{k} AS (SELECT *, {alpha}e0*soft+{1 - alpha}e0*prior AS nw FROM x{k}),
z{k} AS (SELECT *, 0.5e0*b+0.5e0*nw/sum(nw) {W} AS nb FROM y{k}), r{k} AS (SELECT locus, v, soft, nb/sum(nb) {W} AS b, prior FROM z{k})"""
    return out + f", hb AS (SELECT hh.locus, hh.v, z, n_neighbors, uq, b AS pip, prior*max(z) {W} AS zf FROM hh JOIN r{last} USING (locus,v))"


_RANKED = "(PARTITION BY locus ORDER BY round(pip,12) DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
HBP = "," + _belief() + f" SELECT locus, v, round(z,6) AS z, round(uq,6) AS unique_stat, n_neighbors, round(zf,6) AS z_functional, round(0.6e0*uq+0.4e0*zf,6) AS combined_score, round(pip,6) AS pip, coalesce(sum(pip) OVER {_RANKED},0)<0.95 AS in_credible_set FROM hb"


def ensemble(abf: str) -> str:
    """Of gafm_mx (pp: pip at alpha 0.7) and hbp_mx, both by the mixture factor abf."""
    mixed = lambda of, name: f"{name} AS (SELECT locus, v, z, n_neighbors, uq, least(greatest(x*sum(pip) {W}/sum(x) {W},0),1) AS pip FROM (SELECT *, pip*({abf}) AS x FROM {of}, (SELECT n AS nn FROM n)))"
    return f""",{mixed('pp', 'ga')}, {_belief()}, {mixed('hb', 'hm')}, en AS (SELECT ga.locus, ga.v, ga.z, ga.n_neighbors, ga.uq, 0.5e0*ga.pip+0.5e0*hm.pip AS pip FROM ga JOIN hm USING (locus,v))
SELECT locus, v, round(z,6) AS z, n_neighbors, round(uq,6) AS unique_stat, round(0.7e0*uq,6) AS combined_score, 0e0 AS z_functional, round(pip,6) AS pip, CASE WHEN sum(pip) {W}<=1e-9 THEN row_number() OVER (PARTITION BY locus ORDER BY round(pip,12) DESC, v)=1 ELSE coalesce(sum(pip) OVER {_RANKED},0)<0.95*sum(pip) {W} END AS in_credible_set FROM en"""


def cross_locus(rounds: int = 3) -> str:
    out = f""", d0 AS (SELECT locus, v, z, n_neighbors, uq, exp(uq-max(uq) {W}) AS e FROM uq WHERE cnt>=3), vp AS (SELECT DISTINCT v, pathway FROM variant JOIN gene_pathway USING (gene)),
p0 AS (SELECT locus, v, z, n_neighbors, uq, 0e0 AS cross_prior, uq AS comb, e/sum(e) {W} AS pip FROM d0)"""
    for k in range(1, rounds + 1):
        out += f""", h{k} AS (SELECT locus, v, pip, pathway FROM p{k - 1} JOIN vp USING (v)), o{k} AS (SELECT locus, pathway, sum(pip) AS own FROM h{k} GROUP BY 1,2),
q{k} AS (SELECT locus, pathway, greatest(sum(own) OVER (PARTITION BY pathway)-own,0) AS rest FROM o{k}), c{k} AS (SELECT h{k}.locus, v, sum(rest) AS c FROM h{k} JOIN q{k} USING (locus,pathway) GROUP BY 1,2),
t{k} AS (SELECT p.*, coalesce(c,0) AS c FROM p{k - 1} p LEFT JOIN c{k} USING (locus,v)), u{k} AS (SELECT locus, v, z, n_neighbors, uq, CASE WHEN max(c) {W}>0 THEN c/max(c) {W} ELSE 0 END AS cross_prior, max(z) {W} AS zt FROM t{k}),
s{k} AS (SELECT *, 0.7e0*uq+0.3e0*(0.3e0*cross_prior)*zt AS comb FROM u{k}), f{k} AS (SELECT *, exp(comb-max(comb) {W}) AS e FROM s{k}), p{k} AS (SELECT locus, v, z, n_neighbors, uq, cross_prior, comb, e/sum(e) {W} AS pip FROM f{k})"""
    return out + f" SELECT locus, v, round(z,6) AS z, n_neighbors, round(uq,6) AS unique_stat, 0e0 AS z_func, round(cross_prior,6) AS cross_prior, round(comb,6) AS combined_score, round(pip,6) AS pip, coalesce(sum(pip) OVER {_RANKED},0)<0.95 AS in_credible_set FROM p{rounds}"


CLUMPED = """, cl AS (SELECT chr, pos, t AS beta, p AS pval, row_number() OVER (PARTITION BY chr ORDER BY p, pos) AS k FROM (SELECT v, t, {p} AS p FROM run_b) JOIN variant USING (v) WHERE p<0.2),
st(chr,k,kept) AS (SELECT chr, k, [pos] FROM cl WHERE k=1 UNION ALL SELECT cl.chr, cl.k, CASE WHEN len(list_filter(kept, lambda x: abs(x-cl.pos)<=250000))=0 THEN list_append(kept, cl.pos) ELSE kept END FROM st JOIN cl ON cl.chr=st.chr AND cl.k=st.k+1)
SELECT cl.chr, pos, 'A' AS ref, 'G' AS alt, round(beta,6) AS beta, 1e0 AS se, round(pval,6) AS pval, CAST(row_number() OVER (PARTITION BY cl.chr ORDER BY cl.k) AS INT) AS rank FROM cl JOIN st ON st.chr=cl.chr AND st.k=cl.k AND st.kept[len(st.kept)]=pos"""


def _sweeps(columns: list[str], pivots: int) -> str:
    """Sweeps of the symmetric matrix m_i_j (i <= j) over `columns`, one table for each pivot: sw0 to sw{pivots}."""
    n, out = len(columns), ""
    at = lambda i, j: f"m_{min(i, j)}_{max(i, j)}"
    for p in range(pivots):
        cells = []
        for i in range(n):
            for j in range(i, n):
                if i == p and j == p:
                    x = f"-1/{at(p, p)}"
                elif p in (i, j):
                    x = f"{at(i, j)}/{at(p, p)}"
                else:
                    x = f"{at(i, j)}-{at(i, p)}*{at(p, j)}/{at(p, p)}"
                cells.append(f"{x} AS {at(i, j)}")
        out += f", sw{p + 1} AS (SELECT v1, v2, n, {', '.join(cells)} FROM sw{p})"
    return out


def interactions(pairs: str, n_min: int = 20) -> str:
    """it(v1, v2, beta1, beta2, beta, se, p): the product term of the regression on both dosages, by sweeping the sums."""
    cells = dict(zip("00 01 02 03 04 11 12 13 14 22 23 24 33 34 44".split(), "kn g_1 g_2 x sy gg_1 x xg1 gy_1 gg_2 xg2 gy_2 xx xy syy".split(), strict=True))
    return f"""pr AS ({pairs}), known AS (SELECT count(*)*1e0 AS kn, sum(y) AS sy, sum(y*y) AS syy FROM sample), gr AS (SELECT v, s, CAST(g AS DOUBLE) AS g, y FROM genotype JOIN sample USING (s)),
iv AS (SELECT v, sum(g) AS g, sum(g*g) AS gg, sum(g*y) AS gy FROM gr GROUP BY v),
bt AS (SELECT v1, v2, sum(a.g*b.g) AS x, sum(a.g*b.g*a.g*b.g) AS xx, sum(a.g*b.g*a.y) AS xy, sum(a.g*a.g*b.g) AS xg1, sum(a.g*b.g*b.g) AS xg2 FROM pr JOIN gr a ON a.v=v1 JOIN gr b ON b.v=v2 AND b.s=a.s GROUP BY 1,2),
sm AS (SELECT bt.*, p.g AS g_1, p.gg AS gg_1, p.gy AS gy_1, q.g AS g_2, q.gg AS gg_2, q.gy AS gy_2, kn, sy, syy FROM bt JOIN iv p ON p.v=v1 JOIN iv q ON q.v=v2, known),
sw0 AS (SELECT v1, v2, kn AS n, {', '.join(f'{c} AS m_{k[0]}_{k[1]}' for k, c in cells.items())} FROM sm){_sweeps(['1', 'g1', 'g2', 'x', 'y'], 4)},
es AS (SELECT v1, v2, n, m_1_4 AS beta1, m_2_4 AS beta2, m_3_4 AS beta, sqrt(greatest(greatest(m_4_4,0)/(n-4)*(-m_3_3),0)) AS se FROM sw4),
it AS (SELECT v1, v2, beta1, beta2, beta, se, CASE WHEN se>0 THEN {t_p_sql('beta/se', '(n-4)')} ELSE 1 END AS p FROM es)"""


MOTIF_SCAN = """, mac AS (SELECT v FROM genotype GROUP BY v HAVING least(sum(g), 2*(SELECT n FROM n)-sum(g))>=10), {it},
bh AS (SELECT *, least(p*count(*) OVER ()/row_number() OVER (ORDER BY p, v1, v2),1) AS q FROM it), ad AS (SELECT *, min(q) OVER (ORDER BY p DESC, v1 DESC, v2 DESC ROWS UNBOUNDED PRECEDING) AS pc FROM bh)
SELECT v1, v2, round(beta1,6) AS beta1, round(beta2,6) AS beta2, round(beta,6) AS beta, round(se,6) AS se, round(p,6) AS p_value, round(pc,6) AS p_corrected, entity, motif FROM ad JOIN mp USING (v1,v2)"""

DIFFERENTIAL = f""", nn AS (SELECT n_case, n-n_case AS n_ctrl, 1e0/greatest(n_case,n-n_case) AS ps FROM n),
c2 AS (SELECT *, log2((co_case/n_case+ps)/(co_ctrl/n_ctrl+ps)) AS lfr FROM co, nn WHERE co_case>=2 OR co_ctrl>=2),
c3 AS (SELECT *, CASE WHEN co_case>=5 AND co_ctrl<2 THEN 'case_unique' WHEN co_ctrl>=5 AND co_case<2 THEN 'ctrl_unique' WHEN abs(lfr)>1 THEN 'differential' ELSE 'shared' END AS edge_type, {fisher('co_case', '(n_case-co_case)', 'co_ctrl', '(n_ctrl-co_ctrl)')} AS fisher, count(*) OVER () AS m FROM c2)
SELECT v1, v2, co_case, co_ctrl, round(lfr,6) AS lfr, edge_type, round(fisher,6) AS fisher, round(least(fisher*m,1),6) AS p_corrected FROM c3 WHERE fisher<0.05 OR edge_type IN ('case_unique','ctrl_unique')"""

DEPLETION = """WITH nn AS (SELECT n_case*1e0 AS n_case, (n-n_case)*1e0 AS n_ctrl FROM n), fr AS (SELECT v, count(*) FILTER (is_case)/n_case AS a, count(*) FILTER (NOT is_case)/n_ctrl AS b FROM genotype JOIN sample USING (s), nn GROUP BY v, n_case, n_ctrl),
mp AS (SELECT a.v AS v1, b.v AS v2 FROM variant a JOIN variant b ON a.chr=b.chr AND a.v<b.v AND abs(a.pos-b.pos)<=150000),
ep AS (SELECT v1, v2, n_case*x.a*y.a AS exp_case, n_ctrl*x.b*y.b AS exp_ctrl FROM mp JOIN fr x ON x.v=v1 JOIN fr y ON y.v=v2, nn WHERE n_case*x.a*y.a>=1),
co AS (SELECT v1, v2, count(*) FILTER (is_case) AS co_case, count(*) FILTER (NOT is_case) AS co_ctrl FROM ep JOIN genotype a ON a.v=v1 JOIN genotype b ON b.v=v2 AND b.s=a.s JOIN sample ON sample.s=a.s GROUP BY 1,2),
al AS (SELECT v1, v2, exp_case, exp_ctrl, coalesce(co_case,0) AS co_case, coalesce(co_ctrl,0) AS co_ctrl FROM ep LEFT JOIN co USING (v1,v2)),
st AS (SELECT *, CASE WHEN exp_case>0 THEN co_case/exp_case ELSE 1 END AS ratio_case, CASE WHEN exp_ctrl>0 THEN co_ctrl/exp_ctrl ELSE 1 END AS ratio_ctrl, least(list_sum(list_transform(range(0,co_case+1), lambda i: exp(i*ln(exp_case)-exp_case-lgamma(i+1)))),1) AS poisson,
 (co_ctrl-exp_ctrl)/sqrt(greatest(exp_ctrl,1)+1)-(co_case-exp_case)/sqrt(exp_case+1) AS z_difference, count(*) OVER () AS m FROM al)
SELECT v1, v2, round(exp_case,6) AS exp_case, round(exp_ctrl,6) AS exp_ctrl, co_case, co_ctrl, round(ratio_case,6) AS ratio_case, round(ratio_ctrl,6) AS ratio_ctrl, round(poisson,6) AS poisson, round(z_difference,6) AS z_difference, round(least(poisson*m,1),6) AS p_corrected FROM st WHERE (ratio_case<0.8 AND ratio_ctrl>0.8) OR (poisson<0.01 AND z_difference>1)"""

MDR = f"""WITH kn AS (SELECT s, is_case, {md5_number('CAST(s AS VARCHAR)')}%10 AS fold FROM sample), mp AS ({{pairs}}),
ce AS (SELECT v1, v2, kn.s, is_case, fold, coalesce(a.g,0) AS g1, coalesce(b.g,0) AS g2 FROM mp JOIN kn ON true LEFT JOIN genotype a ON a.v=v1 AND a.s=kn.s LEFT JOIN genotype b ON b.v=v2 AND b.s=kn.s),
al AS (SELECT v1, v2, fold, g1, g2, count(*) FILTER (is_case) AS a, count(*) FILTER (NOT is_case) AS b FROM ce GROUP BY ALL),
ro AS (SELECT *, sum(a) OVER c-a AS ta, sum(b) OVER c-b AS tb, sum(a) OVER p-sum(a) OVER f AS pa, sum(b) OVER p-sum(b) OVER f AS pb FROM al WINDOW c AS (PARTITION BY v1,v2,g1,g2), p AS (PARTITION BY v1,v2), f AS (PARTITION BY v1,v2,fold)),
pe AS (SELECT v1, v2, fold, sum(CASE WHEN ta*pb>=tb*pa AND ta+tb>0 THEN a ELSE 0 END)*1e0/nullif(sum(a),0) AS sens, sum(CASE WHEN ta*pb>=tb*pa AND ta+tb>0 THEN 0 ELSE b END)*1e0/nullif(sum(b),0) AS spec FROM ro GROUP BY 1,2,3)
SELECT v1, v2, round(avg((sens+spec)/2),6) AS accuracy FROM pe GROUP BY 1,2"""

#: A walk of variants over their pathways needs only the pathways' own small matrix.
WALKS = """WITH RECURSIVE {panel}, vp AS (SELECT DISTINCT v, pathway AS g FROM variant JOIN gene_pathway USING (gene)), va AS (SELECT v, g, 1e0/count(*) OVER (PARTITION BY v) AS a, 1e0/count(*) OVER (PARTITION BY g) AS b FROM vp),
tt AS (SELECT x.g, y.g AS h, sum(x.b*y.a) AS t FROM va x JOIN va y USING (v) GROUP BY 1,2),
po(k,g,h,t) AS (SELECT 0, g, g, 1e0 FROM (SELECT DISTINCT g FROM vp) UNION ALL SELECT k, g, h, t FROM (SELECT po.k+1 AS k, po.g, tt.h, sum(po.t*tt.t) AS t FROM po JOIN tt ON tt.g=po.h WHERE po.k<49 GROUP BY 1,2,3)),
su AS (SELECT g, h, sum(t*power(0.85,k+1)*CASE WHEN k=49 THEN 1 ELSE 0.15 END) AS t FROM po GROUP BY 1,2),
wa AS (SELECT y.v AS seed, x.v, sum(x.a*su.t*y.b)+CASE WHEN x.v=y.v THEN 0.15 ELSE 0 END AS p FROM va x JOIN su ON su.g=x.g JOIN va y ON y.g=su.h GROUP BY 1,2),
wn AS (SELECT seed, v, p/sum(p) OVER (PARTITION BY seed) AS p FROM wa)
SELECT v1, v2, round(score,9) AS score FROM (SELECT a.seed AS v1, a.v AS v2, a.p*b.p AS score FROM wn a JOIN wn b ON b.seed=a.v AND b.v=a.seed WHERE a.seed<a.v) WHERE score>0 ORDER BY round(score,12) DESC, v1, v2 LIMIT 200"""

PAGERANK = """WITH RECURSIVE {panel}, bo AS (SELECT a, b, score*1e0 AS w FROM ppi UNION ALL SELECT b, a, score FROM ppi), ou AS (SELECT a, sum(w) AS t, count(*) OVER () AS n FROM bo GROUP BY a),
st AS (SELECT bo.a, b, w/t AS p, n FROM bo JOIN ou USING (a)), ra(k,node,rank) AS (SELECT 0, a, 1e0/n FROM ou UNION ALL SELECT * FROM (SELECT ra.k+1 AS k, b AS node, 0.15e0/n+0.85e0*sum(p*rank) AS rank FROM ra JOIN st ON st.a=ra.node WHERE ra.k<50 GROUP BY 1,2,n))
SELECT node, round(rank,9) AS rank FROM ra WHERE k=50"""

_PHI = "sum(w*a*b) AS cut, sum(w*a*(a+b-1)) AS x, sum(w*b*(a+b-1)) AS y"
PERMUTED = f""", pe AS (SELECT s, d, row_number() OVER (PARTITION BY d ORDER BY {md5_number("concat(s,':',d,':42')", 15)}, s)<=(SELECT n_case FROM n) AS is_case FROM sample, range(0,200) r(d)),
ob AS (SELECT v, 1/af AS w, CAST(count(*) FILTER (is_case) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT is_case) AS DOUBLE) AS b FROM genotype JOIN sample USING (s) JOIN rare USING (v) GROUP BY 1,2),
ph AS (SELECT CASE WHEN least(x,y)>0 THEN cut/least(x,y) ELSE 0 END AS phi FROM (SELECT {_PHI} FROM ob)),
nl AS (SELECT d, v, 1/af AS w, CAST(count(*) FILTER (is_case) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT is_case) AS DOUBLE) AS b FROM genotype JOIN rare USING (v) JOIN pe USING (s) GROUP BY 1,2,3),
np AS (SELECT d, CASE WHEN least(x,y)>0 THEN cut/least(x,y) ELSE 0 END AS phi FROM (SELECT d, {_PHI} FROM nl GROUP BY d)), st AS (SELECT avg(np.phi) AS m, (count(*) FILTER (np.phi<=ph.phi)+1)/(count(*)+1e0) AS p FROM np, ph)
SELECT round(phi,6) AS phi, round(m,6) AS phi_null, round(CASE WHEN m>0 THEN greatest(1-phi/m,0) ELSE 0 END,6) AS h2, round(p,6) AS p_value FROM ph, st"""

#: One row for each variant of the combined matrices: cells that a matrix lacks are no rows here.
SV_SCAN = f"""WITH cm AS (SELECT s FROM genotype INTERSECT SELECT s FROM genotype WHERE v%4=0), ce AS (SELECT CAST(v AS VARCHAR) AS v, s, CAST(g AS DOUBLE) AS g FROM genotype UNION ALL SELECT CAST(v+1000000 AS VARCHAR), s, g*2 FROM genotype WHERE v%4=0),
mo AS (SELECT v, count(*) AS n, sum(g) AS sg, sum(g*g) AS sgg, sum(g*y) AS sgy, sum(y) AS sy, sum(y*y) AS syy FROM ce JOIN (SELECT s, round(y*100) AS y FROM sample) USING (s) WHERE s IN (SELECT s FROM cm) GROUP BY v),
cv AS (SELECT *, sgg*n-sg*sg AS vg, syy*n-sy*sy AS vy, sgy*n-sg*sy AS c FROM mo), ft AS (SELECT v, n, CASE WHEN n>=10 AND vg>0 AND vy>0 THEN c/vg ELSE 0 END AS beta, CASE WHEN n>=10 AND vg>0 AND vy>0 THEN least(c*c/(vg*vy),1) ELSE 0 END AS r2 FROM cv),
tt AS (SELECT *, CASE WHEN r2<1 AND beta<>0 THEN sign(beta)*sqrt(r2*(n-2)/(1-r2)) ELSE 0 END AS t FROM ft)
SELECT v, n, round(beta/100,6) AS beta, round(r2,9) AS r2, round(t,6) AS t, CASE WHEN t<>0 THEN round(beta/t/100,6) END AS se, round(CASE WHEN t=0 THEN 1 ELSE {t_p_sql('t', '(n-2)')} END,6) AS p_value FROM tt"""

SV_HERITABILITY = f"""WITH cm AS (SELECT s FROM genotype WHERE v%4>0 INTERSECT SELECT s FROM genotype WHERE v%4=0), ty AS (SELECT CAST(v AS VARCHAR) AS v, s, CAST(g AS DOUBLE) AS g, CASE WHEN v%4=0 THEN 'cnv' ELSE 'snp' END AS type FROM genotype WHERE s IN (SELECT s FROM cm)),
ce AS (SELECT type AS "set", v, s, g FROM ty UNION ALL SELECT 'all', v, s, g FROM ty), pa AS (SELECT s, y, {md5_number('CAST(s AS VARCHAR)')}%2 AS k FROM sample),
mo AS (SELECT "set", v, count(*) AS n, sum(g) AS sg, sum(g*g) AS sgg, sum(g*y) AS sgy, sum(y) AS sy, sum(y*y) AS syy FROM ce JOIN pa USING (s) WHERE k=0 GROUP BY 1,2),
cv AS (SELECT *, sgg*n-sg*sg AS vg, syy*n-sy*sy AS vy, sgy*n-sg*sy AS c FROM mo), ft AS (SELECT "set", v, n, c/vg AS beta, least(c*c/(vg*vy),1) AS r2 FROM cv WHERE n>=10 AND vg>0 AND vy>0),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "set" ORDER BY CASE WHEN r2<1 THEN sqrt(r2*(n-2)/(1-r2)) ELSE 0 END DESC, v) AS r FROM ft) WHERE r<=50),
sc AS (SELECT "set", s, sum(beta*g) AS x, any_value(y) AS y FROM ce JOIN be USING ("set",v) JOIN pa USING (s) WHERE k=1 GROUP BY 1,2)
SELECT "set", count(*) AS n_samples, round(CASE WHEN var_pop(x)>0 AND var_pop(y)>0 THEN power(corr(x,y),2) ELSE 0 END,6) AS r2 FROM sc GROUP BY 1"""

_ERFC = lambda x: f"CASE WHEN {x}>=0 THEN {erfc_sql(x)} ELSE 2-{erfc_sql(f'(-{x})')} END"
_SHIFT = 2**0.5
BIAS = f"""WITH z AS (SELECT s, g*1e0 AS z FROM genotype WHERE v=1), d AS (SELECT coalesce(g,0) AS g, z FROM z LEFT JOIN (SELECT s, g FROM genotype WHERE v=0) USING (s)),
r AS (SELECT CASE WHEN var_pop(g)>0 AND var_pop(z)>0 THEN abs(corr(g,z)) ELSE 0 END AS rho FROM d), m AS (SELECT rho, rho*sqrt(0.2e0*n)/sqrt(1-0.2e0*rho*rho) AS mu, (1-0.2e0*rho*rho)/0.8e0 AS sigma2 FROM r, n)
SELECT 0 AS v, round(rho,6) AS rho, round(mu,6) AS mu, round(sigma2,6) AS sigma2, round(({_ERFC(f'((5.45e0-mu)/{_SHIFT!r}e0)')}+{_ERFC(f'((5.45e0+mu)/{_SHIFT!r}e0)')})/(2*{erfc_sql(f'(5.45e0/{_SHIFT!r}e0)')}),4) AS ratio FROM m"""

_U = lambda k: f"(({md5_number(f'''concat(s,':42:{k}')''')}+1)/4503599627370497e0)"
SIMULATED = f"""WITH me AS (SELECT v, sum(g)/CAST((SELECT n FROM n) AS DOUBLE) AS m FROM genotype WHERE v IN (0,7) GROUP BY v),
x AS (SELECT s, 0.5e0*(coalesce(max(g) FILTER (genotype.v=0),0)-coalesce((SELECT m FROM me WHERE v=0),0))+0.3e0*(coalesce(max(g) FILTER (genotype.v=7),0)-coalesce((SELECT m FROM me WHERE v=7),0)) AS x FROM sample LEFT JOIN genotype USING (s) GROUP BY s)
SELECT s, round(x,6) AS genetic_value, round(x+sqrt(greatest((SELECT var_pop(x) FROM x),1e-12)*9)*sqrt(-2*ln({_U(1)}))*cos(2*pi()*{_U(2)}),6) AS y FROM x"""

#: Shared carriers' products, and what absent genotypes add, from each sample's own sums.
RELATIONSHIP = """WITH fr AS (SELECT v, sum(g)/(2e0*(SELECT n FROM n)) AS af FROM genotype GROUP BY v HAVING sum(g)/(2e0*(SELECT n FROM n))>0.01 AND sum(g)/(2e0*(SELECT n FROM n))<0.99),
sd AS (SELECT v, s, g/sqrt(2*af*(1-af)) AS x, 2*af/sqrt(2*af*(1-af)) AS c FROM genotype JOIN fr USING (v)), tt AS (SELECT count(*) AS m, sum(2*af/(1-af)) AS cc FROM fr),
ow AS (SELECT sample.s, coalesce(sum(x*c),0) AS xc FROM sample LEFT JOIN sd USING (s) GROUP BY 1), bo AS (SELECT a.s AS i, b.s AS j, sum(a.x*b.x) AS xx FROM sd a JOIN sd b ON a.v=b.v AND a.s<=b.s GROUP BY 1,2)
SELECT p.s AS i, q.s AS j, round((coalesce(xx,0)-p.xc-q.xc+cc)/m,6) AS w FROM ow p JOIN ow q ON p.s<=q.s LEFT JOIN bo ON i=p.s AND j=q.s, tt"""


def leading_component(rounds: int = 45) -> str:
    """Power steps from a vector of remainders; products with the standardised genotypes by carriers and constants."""
    out = """WITH fr AS MATERIALIZED (SELECT v, sum(g)/(2e0*(SELECT n FROM n)) AS af FROM genotype GROUP BY v HAVING sum(g)/(2e0*(SELECT n FROM n))>0.01 AND sum(g)/(2e0*(SELECT n FROM n))<0.99),
sd AS MATERIALIZED (SELECT v, s, g/sqrt(2*af*(1-af)) AS x, 2*af/sqrt(2*af*(1-af)) AS c FROM genotype JOIN fr USING (v)), p0 AS MATERIALIZED (SELECT s, (s%7)-3e0 AS x, 1e0 AS size FROM sample)"""
    for k in range(1, rounds + 1):
        out += f""", u{k} AS MATERIALIZED (SELECT v, sum(sd.x*p.x)-any_value(c)*(SELECT sum(x) FROM p{k - 1}) AS u, any_value(c) AS c FROM sd JOIN p{k - 1} p USING (s) GROUP BY v),
y{k} AS MATERIALIZED (SELECT sample.s, coalesce(sum(sd.x*u),0)-(SELECT sum(c*u) FROM u{k}) AS y FROM sample LEFT JOIN sd USING (s) LEFT JOIN u{k} USING (v) GROUP BY 1),
p{k} AS MATERIALIZED (SELECT s, y/sqrt((SELECT sum(y*y) FROM y{k})) AS x, sqrt((SELECT sum(y*y) FROM y{k})) AS size FROM y{k})"""
    return out + f""", w AS (SELECT s, x*sign((SELECT arg_max(x, abs(x)) FROM p{rounds})) AS x, size/(SELECT count(*) FROM fr) AS value FROM p{rounds})
SELECT s, round(x*sqrt(value),4)+0e0 AS pc, round(value,4) AS eigenvalue FROM w"""


LEADING_COMPONENT = leading_component()


def evaluation(rounds: int = 10) -> str:
    """Newton's rounds of the logistic regression on the scaled score, each a row of sums."""
    out = """WITH w AS (SELECT s, is_case, CAST(coalesce(sum(g),0) AS DOUBLE) AS score FROM sample LEFT JOIN genotype USING (s) GROUP BY 1,2), st AS (SELECT avg(score) AS m, stddev_pop(score) AS d, quantile_cont(score,0.1) AS lo, quantile_cont(score,0.9) AS hi FROM w),
x AS (SELECT (score-m)/d AS x, CAST(is_case AS INT)*1e0 AS y, score, lo, hi FROM w, st), b0 AS (SELECT 0e0 AS b0, 0e0 AS b1)"""
    for k in range(1, rounds + 1):
        out += f""", l{k} AS (SELECT b0, b1, sum(y-p) AS u, sum((y-p)*x) AS v, sum(p*(1-p)) AS a, sum(p*(1-p)*x) AS b, sum(p*(1-p)*x*x) AS c FROM (SELECT *, 1/(1+exp(-(b0+b1*x))) AS p FROM x, b{k - 1}) GROUP BY 1,2),
b{k} AS (SELECT b0+(c*u-b*v)/(a*c-b*b) AS b0, b1+(a*v-b*u)/(a*c-b*b) AS b1 FROM l{k})"""
    return out + f""", fi AS (SELECT count(*) AS n, avg(y) AS r, sum(y*ln(p)+(1-y)*ln(1-p)) AS l1, count(*) FILTER (score>=hi AND y=1)+0.5 AS ta, count(*) FILTER (score>=hi AND y=0)+0.5 AS tb, count(*) FILTER (score<=lo AND y=1)+0.5 AS la, count(*) FILTER (score<=lo AND y=0)+0.5 AS lb FROM (SELECT *, 1/(1+exp(-(b0+b1*x))) AS p FROM x, b{rounds})),
r AS (SELECT is_case, rank() OVER (ORDER BY score)+(count(*) OVER (PARTITION BY score)-1)/2e0 AS k FROM w), au AS (SELECT count(*) FILTER (is_case) AS na, count(*) FILTER (NOT is_case) AS nb, sum(k) FILTER (is_case) AS sk FROM r),
l0 AS (SELECT *, n*(r*ln(r)+(1-r)*ln(1-r)) AS l0 FROM fi)
SELECT na AS n_cases, nb AS n_controls, round((sk-na*(na+1)/2e0)/(na*nb),6) AS auroc, round((1-exp(2e0/n*(l0-l1)))/(1-exp(2e0/n*l0)),6) AS nagelkerke_r2, round(CAST(ta AS DOUBLE)*lb/(CAST(tb AS DOUBLE)*la),6) AS decile_or FROM l0, au"""
