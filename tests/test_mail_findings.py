from sleuthgrid.operators.mail import SEVERITIES, _rules, mail_findings

TOP = "Received: from out.sender.org (out.sender.org [8.8.8.8])\n by mx.rcpt.net with ESMTPS; Mon, 01 Jan 2024 12:00:00 +0000\n"
GOOD = TOP + "Authentication-Results: mx.rcpt.net; spf=pass smtp.mailfrom=a@sender.org; dkim=pass header.d=sender.org; dmarc=pass\nFrom: A Person <a@sender.org>\nMessage-ID: <1@sender.org>\nDate: Mon, 01 Jan 2024 11:59:00 +0000\nReturn-Path: <a@mail.sender.org>\n"
CASES = {
    GOOD: {"dkim_aligned", "spf_aligned", "origin_established"},
    GOOD.replace("dkim=pass", "dkim=fail").replace("dmarc=pass", "dmarc=fail; compauth=fail"): {"dkim_fail", "dmarc_fail", "compauth_fail", "spf_aligned", "origin_established"},
    GOOD.replace("mx.rcpt.net; spf", "other.test; spf"): {"auth_untrusted", "spf_aligned", "origin_established"},
    GOOD + "Authentication-Results: sender.org; dkim=pass\n": {"dkim_aligned", "spf_aligned", "origin_established", "auth_self_asserted"},
    GOOD.replace("header.d=sender.org", "header.d=other.com"): {"dkim_unaligned", "spf_aligned", "origin_established"},
    TOP + "From: \"pay@bank.com\" <a@sender.org>\nReply-To: b@other.com\nX-Originating-IP: [9.9.9.9]\nReturn-Path: <x@bulk.com>\nMessage-ID: <1@third.org>\n": {"auth_not_checked", "display_name_spoof", "reply_to_mismatch", "originating_ip_disagrees", "spf_unaligned", "message_id_mismatch", "origin_established"},
    TOP + "Received: from x.bank.com by y.bank.com; d\nFrom: a@bank.com\nDate: Tue, 09 Jan 2024 12:00 GMT\nFrom: second@x.org\n": {"auth_not_checked", "chain_claims_another_origin", "origin_established", "date_skew", "parse_note"},
    TOP + "Received: from x.bank.com by y.bank.com; d\nFrom: a@sender.org\nDate: never\n": {"auth_not_checked", "chain_below_boundary", "origin_established", "parse_note"},
    "From: a@b.org\n": {"auth_not_checked", "origin_unproven"}, "": {"auth_not_checked", "origin_unproven"}, None: {"auth_not_checked", "origin_unproven"}, "no header at all": {"auth_not_checked", "origin_unproven"},
}


def test_all_findings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, blob string").selectExpr("*", "1 as fields", "2 as auth").drop("fields", "auth")
    got = {r["i"]: r["findings"] for r in mail_findings(df, ["i"], "blob").collect()}
    for i, (text, want) in enumerate(CASES.items()):
        assert {f["key"] for f in got[i]} == want, text
        assert [SEVERITIES.index(f["severity"]) for f in got[i]] == sorted(SEVERITIES.index(f["severity"]) for f in got[i]) and all(f["detail"] for f in got[i])
    assert {f["key"] for x in got.values() for f in x} == {r[0] for r in _rules()} | {"parse_note"}
