from checks.base import category, with_ev, with_lab

_PAIR = "pr AS (SELECT CASE WHEN severity = 'crit' THEN 'SYSTEM' ELSE predicted_category END AS l, predicted_category AS p FROM lab)"

SQL = {
    "predict_category": with_ev(f"SELECT event_id, {category('message')} AS predicted_category, CAST(0.0 AS DOUBLE) AS predicted_confidence FROM ev"),
    "stratified_split": with_lab("""SELECT event_id, predicted_category AS label, row_number() OVER (PARTITION BY predicted_category ORDER BY md5('42:' || event_id), event_id)
        <= floor(count(*) OVER (PARTITION BY predicted_category) * 0.2) AS is_test FROM lab"""),
    "classification_report": with_lab("""SELECT category, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1
      FROM (SELECT category, (SELECT count(*) FROM pr WHERE l = category) AS support,
        CASE WHEN (SELECT count(*) FROM pr WHERE p = category) > 0 THEN (SELECT count(*) FROM pr WHERE p = category AND l = category) / (SELECT count(*) FROM pr WHERE p = category) ELSE 0.0 END AS p,
        CASE WHEN (SELECT count(*) FROM pr WHERE l = category) > 0 THEN (SELECT count(*) FROM pr WHERE p = category AND l = category) / (SELECT count(*) FROM pr WHERE l = category) ELSE 0.0 END AS r
      FROM (SELECT l AS category FROM pr UNION SELECT p FROM pr))""", _PAIR),
}
