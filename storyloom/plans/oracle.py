"""The same queries as SQL for DuckDB, by name."""

from __future__ import annotations

_EX = """ex as (select * from (select *, row_number() over (partition by example_id order by loaded_at desc nulls last, score desc nulls last, coder_code desc nulls last) r0 from example where example_id is not null) where r0 = 1)"""
_PA = """pa as (select * from (select *, row_number() over (partition by passage_id order by loaded_at desc nulls last, speaker desc nulls last, text desc nulls last) r0 from passage where passage_id is not null) where r0 = 1)"""
_LINES = rf"""{_PA}, lines as (select narr_id, row_number() over (partition by narr_id order by scene_idx, a, b) line_no, line from (
 select narr_id, scene_idx, -1 a, -1 b, min(scene_name) line from scene where scene_name is not null group by narr_id, scene_idx
 union all select narr_id, scene_idx, passage_idx, passage_id, coalesce(speaker || ': ', '') || replace(text, chr(10), ' ') from pa where text is not null) where narr_id is not null)"""
_RESP = f"""{_EX}, {_PA}, own as (select * from ex where passage_id in (select passage_id from pa where speaker = 'Respondent')),
 sc as (select distinct narr_id, scene_idx from scene where narr_id is not null and scene_idx is not null),
 exs as (select narr_id, scene_idx, row_number() over (partition by narr_id, scene_idx order by passage_idx, example_idx, example_id) - 1 k, text, score from own where text is not null),
 rec as (select sc.narr_id, sc.scene_idx, coalesce(string_agg(' ' || e.text, '' order by e.k), '') as text from sc left join exs e on e.narr_id = sc.narr_id and e.scene_idx = sc.scene_idx group by 1, 2)"""


def _clean(c: str) -> str:
    return rf"lower(' ' || regexp_replace(regexp_replace(regexp_replace({c}, '\s?\([^)]*\)', '', 'g'), '[^a-zA-Z .]', '', 'g'), '\s+', ' ', 'g'))"


_SENT = f"""{_RESP}, cl as (select narr_id, scene_idx, {_clean("text")} as text from rec), cx as (select narr_id, scene_idx, k, {_clean("text")} as text, score from exs),
 pieces as (select narr_id, scene_idx, string_split(text, '.') p from cl),
 sen as (select * from (select narr_id, scene_idx, unnest(range(len(p))) sentence_idx, unnest(p) sentence from pieces) where sentence not in ('', ' '))"""
#: Longest common run by gaps and islands on the diagonals of equal words.
_RUN = f"""{_SENT}, sw as (select narr_id, scene_idx, sentence_idx, unnest(range(len(w))) i, unnest(w) word from (select *, string_split(sentence, ' ') w from sen)),
 ew as (select narr_id, scene_idx, k, unnest(range(len(w))) j, replace(unnest(w), '.', '') word from (select *, string_split(text, ' ') w from cx)),
 hit as (select sw.narr_id, sw.scene_idx, sentence_idx, k, i, i - j d from sw join ew on sw.narr_id = ew.narr_id and sw.scene_idx = ew.scene_idx and sw.word = ew.word),
 isl as (select narr_id, scene_idx, sentence_idx, k, d, i - row_number() over (partition by narr_id, scene_idx, sentence_idx, k, d order by i) g from hit),
 runs as (select narr_id, scene_idx, sentence_idx, k, max(n) n from (select narr_id, scene_idx, sentence_idx, k, count(*) n from isl group by narr_id, scene_idx, sentence_idx, k, d, g) group by 1, 2, 3, 4),
 pairs as (select sen.narr_id, sen.scene_idx, sen.sentence_idx, cx.k, sen.sentence, cx.text, cx.score, coalesce(runs.n, 0) n from sen join cx on cx.narr_id = sen.narr_id and cx.scene_idx = sen.scene_idx
  left join runs on runs.narr_id = sen.narr_id and runs.scene_idx = sen.scene_idx and runs.sentence_idx = sen.sentence_idx and runs.k = cx.k)"""
_LABEL = "case score when 0.0 then -1 when 1.0 then -1 when 1.5 then 0 when 2.0 then 1 when 3.0 then 1 end"
_DOCS = f"""{_EX}, docs as (select example_id, {_LABEL} as label, {_clean("text")} as doc from ex where text is not null)"""
_TOK = rf"""{_DOCS}, tok as (select example_id, regexp_extract_all(doc, '(\w*)', 1) t from docs), terms as (select example_id, term, count(*) tf from (select example_id, unnest(t) term from tok) group by 1, 2)"""
_TFIDF = f"""{_TOK}, dfs as (select term, count(*) df from terms group by 1), raw as (select example_id, terms.term, tf, tf * (ln((1 + (select count(*) from docs)) / (1.0 + df)) + 1) v from terms join dfs on dfs.term = terms.term),
 nrm as (select example_id, sqrt(sum(v * v)) nv from raw group by 1), tfidf as (select raw.example_id, term, v / nv as tfidf from raw join nrm on nrm.example_id = raw.example_id)"""
_COEF = f"""{_TFIDF}, lab as (select example_id, label from docs where label is not null), sizes as (select label, count(*) n from lab group by 1),
 coefs as (select s.label, term, round(s / n, 9) coef from (select label, term, sum(tfidf) s from tfidf join lab on lab.example_id = tfidf.example_id group by 1, 2) s join sizes on sizes.label = s.label)"""
_PROB = f"""{_EX}, pr as (select example_id, {_LABEL} as label, length(text) % 7 + 1 a, example_id % 5 + 1 b, length(text) % 11 + 1 c from ex where text is not null),
 probs as (select example_id, label, a / (a + b + c) low, b / (a + b + c) no, c / (a + b + c) high from pr)"""
_PRED = f"""{_PROB}, mn as (select avg(low) ml, avg(no) mo, avg(high) mh from probs), lift as (select example_id, label, (low - ml) / ml a, (no - mo) / mo b, (high - mh) / mh c from probs, mn),
 pred as (select example_id, label, case when a > b and a > c then -1 when c > a and c > b then 1 else 0 end prediction from lift)"""
_HASH = "((({k}) * 2654435761) % 4294967296)"
_SPLIT = f"""{_DOCS}, sp as (select example_id, label, row_number() over (order by {_HASH.format(k="example_id")}, example_id) <= ceil((select count(*) from docs) * 0.66) is_train from docs)"""
_GRID = """gr as (select i, j, k, 300 + 10 * i max_feat, pow(10.0, -4 + j * (3.0 / 19)) c, k + 1 ngram, ((i * 37 + j * 101 + k * 53) % 97) / 100.0 roc from range(20) a(i), range(20) b(j), range(4) c(k))"""
_LI = "li as (select l_orderkey, l_linenumber, l_quantity q, l_discount di, l_tax tx, l_linenumber - 1 y from lineitem)"
_T = "(q - 25) * 2"
_XW = "(q * 0.02 + di * -1.5 + tx * 2.0)"
_TH = [0.2, 0.6, 1.1, 1.5, 2.0, 2.6, 3.0]
_SP = "(ln(1 + exp(-abs({0}))) + greatest(-({0}), 0))"
_FOLDS = f"""{_DOCS}, fr as (select example_id, label from docs where label is not null), folds as (
 select f fold, example_id, label, row_number() over (partition by f order by {_HASH.format(k="example_id * 31 + 1009 * (f + 1)")}, example_id) <= ceil((select count(*) from fr) * 0.1) is_test from fr, range(50) z(f))"""
_NORM = f"{_LI}, mm as (select least(1.0, min(q)) lo, greatest(-1.0, max(q)) hi from li), nw as (select l_orderkey, l_linenumber, (q - lo) / hi normalized from li, mm)"
_TAGS = """case split_part(line, ':', 1) when 'I' then 'Interviewer' when 'THE INTERVIEWER' then 'Interviewer' when 'INTERVIEWER' then 'Interviewer' when 'R' then 'Respondent' when 'RESPONDENT' then 'Respondent'
 when 'MALE SPEAKER' then 'Respondent' when 'FEMALE SPEAKER' then 'Respondent' when 'INTERVIEWEE' then 'Respondent' when 'THE INTERVIEWEE' then 'Respondent' when 'PARTICIPANT' then 'Respondent' when 'ANSWER' then 'Respondent' end"""
_HEAD = "upper(line) in ('HIGH POINT', 'LOW POINT', 'TURNING POINT')"
_PASSAGES = rf"""{_LINES}, l0 as (select narr_id, line_no, line, {_HEAD} head, case when {_HEAD} then null when instr(line, ':') > 0 then {_TAGS} end sp from lines),
 l1 as (select *, sum(head::int) over (partition by narr_id order by line_no) raw, sum(head::int) over (partition by narr_id) heads from l0),
 l2 as (select *, greatest(raw, 1) sid from l1 where heads > 0 and not (raw = 0 and coalesce(sp, '') = 'Respondent')),
 l3 as (select *, coalesce(last_value(sp ignore nulls) over (partition by narr_id, sid order by line_no rows between unbounded preceding and 1 preceding), 'Interviewer') prev from l2),
 l4 as (select *, sum((sp is not null and sp <> prev)::int) over (partition by narr_id, sid order by line_no) pid, (sp is not null and sp <> prev) chg from l3),
 sp as (select narr_id, sid, pid, coalesce(string_agg(case when not head then (case when chg then '' else ' ' end) || (case when sp is not null then regexp_replace(line, '^\w*\s*\w*:\s*', '') else line end) end, '' order by line_no), '') as text from l4 group by 1, 2, 3),
 nm as (select narr_id, sid, max(case upper(line) when 'HIGH POINT' then 'High Point' when 'LOW POINT' then 'Low Point' else 'Turning Point' end) filter (where head) scene_name from l4 group by 1, 2),
 passages as (select sp.narr_id, (sp.sid - 1)::int scene_idx, scene_name, pid::int passage_idx, case when pid % 2 = 0 then 'Interviewer' else 'Respondent' end speaker, text from sp join nm on nm.narr_id = sp.narr_id and nm.sid = sp.sid)"""


def _q(ctes: str, select: str) -> str:
    return f"with {ctes} {select}"


def _text(expression: str, name: str) -> str:
    return _q(_EX, f"select example_id, {expression} as {name} from ex where text is not null")


_UPPER = "case y " + " ".join(f"when {k} then {t}" for k, t in enumerate(_TH)) + " end"
_LOWER = "case y " + " ".join(f"when {k + 1} then {t}" for k, t in enumerate(_TH[:-1])) + " end"
_BARRIER = " + ".join(f"ln({b} - {a})" for a, b in zip(_TH, _TH[1:], strict=False))

ORACLES: dict[str, str] = {
    "scene_passages": _q(_PASSAGES, "select * from passages"),
    "xml_roundtrip": _q(_PASSAGES, "select * from passages"),
    "respondent_examples": _q(_RESP, "select example_id, passage_id, score from own"),
    "respondent_examples_agency": _q(_RESP, "select example_id, passage_id, score from own where dimension = 'agency'"),
    "strip_parens": _text(r"regexp_replace(text, '\s?\([^)]*\)', '', 'g')", "stripped"),
    "alpha_only": _text("regexp_replace(text, '[^a-zA-Z .]', '', 'g')", "alpha"),
    "squeeze_spaces": _text(r"regexp_replace(text, '\s+', ' ', 'g')", "squeezed"),
    "clean_text": _text(_clean("text"), "cleaned"),
    "blank_filter_observed": _q(_RESP, f"select narr_id, scene_idx, length({_clean('text')})::int as n_chars from rec"),
    "scenes_read": _q(_RESP, f"select narr_id, scene_idx, length({_clean('text')})::int as n_chars from rec"),
    "blank_filter_intended": _q(_RESP, f"select narr_id, scene_idx, length({_clean('text')})::int as n_chars from rec where trim({_clean('text')}) <> ''"),
    "speaker_tag": _q(_LINES, f"select narr_id, line_no::int as line_no, case when instr(line, ':') > 0 then split_part(line, ':', 1) end as tag, case when instr(line, ':') > 0 then {_TAGS} end as speaker, {_HEAD} as heading from lines"),
    "strip_speaker": _q(_LINES, r"select narr_id, line_no::int as line_no, regexp_replace(line, '^\w*\s*\w*:\s*', '') as stripped from lines"),
    "file_names": "select distinct narr_id, 'FLSA_' || lpad(n, greatest(3, length(n))::int, '0') || '.xml' as file_name from (select narr_id, trim(narrative_num)::int::varchar n from narrative where regexp_matches(trim(narrative_num), '^[0-9]{1,9}$'))",
    "scene_scores_unpivot": """with l as (select * from (select *, row_number() over (partition by narrative_num order by line_no desc) r from narrative_score where narrative_num is not null) where r = 1)
 select narrative_num, 'HIGH POINT' as scene_name, high_agency as agency, high_communion as communion from l union all select narrative_num, 'LOW POINT', low_agency, low_communion from l union all select narrative_num, 'TURNING POINT', turning_agency, turning_communion from l""",
    "scene_scores_joined": """with l as (select * from (select *, row_number() over (partition by narrative_num order by line_no desc) r from narrative_score where narrative_num is not null) where r = 1),
 u as (select narrative_num, 'HIGH POINT' n, high_agency a, high_communion c from l union all select narrative_num, 'LOW POINT', low_agency, low_communion from l union all select narrative_num, 'TURNING POINT', turning_agency, turning_communion from l)
 select s.scene_id, s.narrative_num, s.scene_name, a as agency, c as communion from (select distinct scene_id, narrative_num, scene_name from scene where scene_id is not null) s join u on u.narrative_num = s.narrative_num and u.n = upper(s.scene_name)""",
    "scene_text": _q(_RESP, "select narr_id, scene_idx, text from rec"),
    "scene_examples": _q(_RESP, "select exs.narr_id, exs.scene_idx, k::int as k, text, score from exs join sc on sc.narr_id = exs.narr_id and sc.scene_idx = exs.scene_idx"),
    "sentences": _q(_SENT, "select narr_id, scene_idx, sentence_idx::int as sentence_idx, sentence from sen"),
    "word_overlap": _q(_RUN, "select narr_id, scene_idx, sentence_idx::int as sentence_idx, k::int as k, n::int as overlap from pairs"),
    "containment": _q(_SENT, "select sen.narr_id, sen.scene_idx, sentence_idx::int as sentence_idx, min(k)::int as k from sen join cx on cx.narr_id = sen.narr_id and cx.scene_idx = sen.scene_idx and contains(cx.text, sen.sentence) group by 1, 2, 3"),
    "sentence_scores": _q(_RUN, "select narr_id, scene_idx, sentence_idx::int as sentence_idx, case when has or n > 0 then score end as score from (select *, contains(text, sentence) has, row_number() over (partition by narr_id, scene_idx, sentence_idx order by contains(text, sentence) desc, case when contains(text, sentence) then 0 else n end desc, k) r from pairs) where r = 1"),
    "score_labels": _q(_EX, f"select example_id, score, ({_LABEL})::int as label from ex"),
    "train_test_split": _q(_SPLIT, "select example_id, label, is_train from sp"),
    "split_counts": _q(_SPLIT, "select is_train, count(*) as n from sp group by 1"),
    "unpaired_split": _q(_DOCS, f"""select a.example_id, b.label, a.rn <= ceil((select count(*) from docs) * 0.66) as is_train from (select example_id, row_number() over (order by {_HASH.format(k="example_id")}, example_id) rn from docs) a
 join (select label, row_number() over (order by {_HASH.format(k="example_id + 7")}, example_id) rn from docs) b on a.rn = b.rn"""),
    "tokens": _q(_TOK, "select term, sum(tf)::bigint as tf from terms group by 1"),
    "ngram_terms": _q(_TOK, """, g as (select example_id, unnest(t) term from tok union all select example_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) from tok union all select example_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) from tok)
 select term, count(*) as tf, count(distinct example_id) as df from g group by 1""").replace(" , g as", ", g as"),
    "top_terms": _q(_TOK, "select term, sum(tf)::bigint as tf from terms group by 1 order by tf desc, term limit 500"),
    "doc_freq": _q(_TOK, "select term, count(*) as df from terms group by 1"),
    "tfidf": _q(_TFIDF, "select example_id, term, round(tfidf, 6) as tfidf from tfidf"),
    "class_term_weights": _q(_COEF, "select label, term, round(coef, 6) as coef from coefs"),
    "top_features_by_class": _q(_COEF, "select label, term, rank::int as rank from (select *, row_number() over (partition by label order by coef desc, term) rank from coefs) where rank <= 20"),
    "joined_features": _q(_COEF, "select label, string_agg(term, ', ' order by coef, term desc) as features from (select *, row_number() over (partition by label order by coef desc, term) rank from coefs) where rank <= 20 group by 1"),
    "top_bottom_features": _q(_COEF, "select term, 'top' as side from (select * from coefs where label = 1 order by coef desc, term limit 15) union all select term, 'bottom' from (select * from coefs where label = 1 order by coef, term limit 15)"),
    "auc_low_high": _q(_PROB, ", r as (select label = 1 p, rank() over (order by round(high - low, 9)) + (count(*) over (partition by round(high - low, 9)) - 1) / 2.0 rk from probs where label <> 0) select round((sum(rk) filter (where p) - count(*) filter (where p) * (count(*) filter (where p) + 1) / 2.0) / (count(*) filter (where p) * count(*) filter (where not p)), 6) as auc from r").replace(" , r as", ", r as"),
    "predict_from_probs": _q(_PRED, "select example_id, prediction from pred"),
    "passage_rollup": _q(_EX, f"select passage_id, case when m < 0 then -1 when m >= 0 then 1 end as rollup from (select passage_id, avg(l) filter (where l <> 0) m from (select passage_id, {_LABEL} l from ex) where l is not null and passage_id is not null group by 1)"),
    "confusion_recall": _q(_PRED, "select label, count(*) as n, round(avg((label = prediction)::int), 6) as recall from pred where label is not null group by grouping sets ((label), ())"),
    "accuracy": _q(_PRED, "select round(avg((label = prediction)::int), 6) as accuracy from pred where label is not null"),
    "mae": _q(_PRED, "select 'lift' as model, round(avg(e), 6) as mae from (select example_id % 5 f, avg(abs(label - prediction)) e from pred where label is not null group by 1)"),
    "param_grid": _q(_GRID, "select max_feat::int as max_feat, round(c, 9) as c, ngram::int as ngram from gr"),
    "score_sheet_read": """with l as (select string_split(string_split(concat_ws(',', coalesce(narrative_num, ''), coalesce(high_agency, ''), coalesce(high_communion, ''), coalesce(high_c3, ''), coalesce(high_c4, ''), coalesce(high_c5, ''), coalesce(low_agency, ''), coalesce(low_communion, ''), coalesce(low_c8, ''), coalesce(low_c9, ''), coalesce(low_c10, ''), coalesce(turning_agency, ''), coalesce(turning_communion, '')), chr(9))[1], ',') c from narrative_score where line_no is not null)
 select c[1] as narrative_num, c[2] as high_agency, c[3] as high_communion, c[7] as low_agency, c[8] as low_communion, c[12] as turning_agency, c[13] as turning_communion from l""",
    "missing_numbers": "select n::int as narrative_num from range(1, 165) t(n) where n not in (select trim(narrative_num)::int from narrative where regexp_full_match(trim(narrative_num), '[0-9]{1,9}'))",
    "grid_best": _q(_GRID, "select * from (select 'best' as which, max_feat::int as max_feat, round(c, 9) as c, ngram::int as ngram, roc from gr order by roc desc, i, j, k limit 1) union all select * from (select 'worst', max_feat::int, round(c, 9), ngram::int, roc from gr order by roc, i, j, k limit 1)"),
    "grid_pivot": _q(_GRID, "select max_feat::int as max_feat, " + ", ".join(f"max(roc) filter (where j = {j}) as c{j}" for j in range(20)) + " from gr where ngram = 2 group by 1"),
    "cv_folds": _q(_FOLDS, "select fold::int as fold, example_id, is_test from folds"),
    "complete_folds": _q(_FOLDS, "select fold::int as fold from folds where not is_test group by 1 having count(distinct label) = (select count(distinct label) from fr)"),
    "sigmoid": _q(_LI, f"select l_orderkey, l_linenumber, round(1 / (1 + exp(-({_T}))), 6) as p from li"),
    "softplus": _q(_LI, f"select l_orderkey, l_linenumber, round({_SP.format(_T)}, 6) as p from li"),
    "ordinal_objective": _q(_LI, f"select round(sum({_SP.format(f'({_UPPER} - {_XW})')} + case when y > 0 then {_SP.format(f'-({_UPPER} - {_XW})')} - ln(1 - exp({_LOWER} - {_UPPER})) else 0 end) - ({_BARRIER}), 2) as objective from li"),
    "ordinal_predict": _q(_LI, f"select l_orderkey, l_linenumber, ({' + '.join(f'(round({_XW}, 9) >= {t})::int' for t in _TH[:-1])}) as k from li"),
    "class_index": _q(_EX, "select example_id, (dense_rank() over (order by score) - 1)::int as y from ex where score is not null"),
    "normalize_weights": _q(_NORM, "select l_orderkey, l_linenumber, round(normalized, 6) as normalized from nw"),
    "highlight": _q(_NORM, "select l_orderkey, l_linenumber, case when normalized <= 0.2 then 'on_green' when normalized <= 0.4 then 'on_cyan' when normalized <= 0.6000000000000001 then 'on_blue' when normalized <= 0.8 then 'on_magenta' else 'on_red' end as highlight from nw"),
    "word_weights": _q(_COEF, r", w as (select example_id, label, unnest(range(len(ws)))::int word_idx, unnest(ws) word from (select example_id, label, list_filter(string_split(regexp_replace(doc, '[^\x00-\x7F]', '', 'g'), ' '), lambda x: x <> '') ws from docs where label is not null)) select w.example_id, word_idx, word, round(coalesce(coef * tfidf, 0), 6) as weight from w left join tfidf t on t.example_id = w.example_id and t.term = word left join coefs c on c.term = word and c.label = w.label").replace(" , w as", ", w as"),
    "residuals": _q(_PRED, "select example_id, prediction - label as residual from pred where label is not null"),
    "class_column": _q(_DOCS, "select example_id, case label when -1 then 'low' when 0 then 'no' else 'high' end as column from docs where label is not null"),
    "tfidf_refit": _q(_TOK, f""", sp as (select example_id, row_number() over (order by {_HASH.format(k="example_id")}, example_id) <= ceil((select count(*) from docs) * 0.66) tr from docs),
 te as (select terms.* from terms join sp on sp.example_id = terms.example_id where not tr), own as (select term, count(*) df from te group by 1), known as (select term, count(*) df from terms join sp on sp.example_id = terms.example_id where tr group by 1),
 v1 as (select example_id, te.term, tf * (ln((1.0 + (select count(*) from sp where not tr)) / (1 + df)) + 1) v from te join own on own.term = te.term), v2 as (select example_id, te.term, tf * (ln((1.0 + (select count(*) from sp where tr)) / (1 + df)) + 1) v from te join known on known.term = te.term),
 n1 as (select example_id, sqrt(sum(v * v)) n from v1 group by 1), n2 as (select example_id, sqrt(sum(v * v)) n from v2 group by 1)
 select v1.example_id, v1.term, round(v1.v / n1.n, 6) as observed, round(v2.v / n2.n, 6) as intended from v1 join n1 on n1.example_id = v1.example_id left join v2 on v2.example_id = v1.example_id and v2.term = v1.term left join n2 on n2.example_id = v1.example_id""").replace(" , sp as", ", sp as"),
    "colored_text": _q(_COEF, r""", w as (select example_id, label, unnest(range(len(ws)))::int word_idx, unnest(ws) word from (select example_id, label, list_filter(string_split(regexp_replace(doc, '[^\x00-\x7F]', '', 'g'), ' '), lambda x: x <> '') ws from docs where label is not null)),
 cv as (select w.example_id, word_idx, word, round(coalesce(coef * tfidf, 0), 6) u from w left join tfidf t on t.example_id = w.example_id and t.term = word left join coefs c on c.term = word and c.label = w.label),
 cw as (select *, round((u - (select least(1.0, min(u)) from cv)) / (select greatest(-1.0, max(u)) from cv), 6) v from cv)
 select example_id, string_agg(chr(27) || '[' || (case when v <= 0.2 then '42' when v <= 0.4 then '46' when v <= 0.6000000000000001 then '44' when v <= 0.8 then '45' else '41' end) || 'm' || chr(27) || '[37m' || word || chr(27) || '[0m', ' ' order by word_idx) as text from cw group by 1""").replace(" , w as", ", w as"),
    "color_key": "select * from (values (0, 'green', 'lowest'), (1, 'cyan', 'low'), (2, 'blue', 'middle'), (3, 'magenta', 'high'), (4, 'red', 'highest')) t(idx, color, meaning)",
}
