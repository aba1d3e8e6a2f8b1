"""The registered queries of this package: (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from spanloom.llm import ann, bpe, decontam, licenses, merkle, mixing, neardup, pii, quality, rules, trie, urls, warc

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_mix": mixing.op2_mix,
    "op3_pii": pii.op3_pii,
    "op4_neardup": neardup.op4_neardup,
    "op5_quality": quality.op5_quality,
    "op6_warc": warc.op6_warc,
    "op7_rules": rules.op7_rules,
    "op8_licenses": licenses.op8_licenses,
    "op9_urls": urls.op9_urls,
    "op10_bpe": bpe.op10_bpe,
    "op11_merkle": merkle.op11_merkle,
    "op12_trie": trie.op12_trie,
    "op13_decontam": decontam.op13_decontam,
}

ORACLES: dict[str, str] = {
    "op2_mix": mixing.OP2_SQL,
    "op6_warc": warc.OP6_SQL,
    "op9_urls": urls.OP9_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_trie": trie.OP12_SQL,
    "op13_decontam": decontam.OP13_SQL,
}
