"""The registered queries of this subpackage and their SQL."""

from rolecast.llm import (chat, leaks, packing, passages, personal, ppm, search, shingles, spelling, suffixes, toxicity,
                          vectors, warc)

QUERIES = {"op1_suffix_array": suffixes.op1_suffix_array, "op2_substring": passages.op2_substring, "op3_vectors": vectors.op3_vectors, "op4_ppm": ppm.op4_ppm,
           "op5_toxicity": toxicity.op5_toxicity,
           "op6_leaks": leaks.op6_leaks, "op7_chat": chat.op7_chat, "op8_packing": packing.op8_packing,
           "op9_jaccard": shingles.op9_jaccard, "op10_warc": warc.op10_warc,
           "op11_ranked_search": search.op11_ranked_search, "op12_spelling": spelling.op12_spelling,
           "op13_personal": personal.op13_personal}
ORACLE = {"op6_leaks": leaks.SQL, "op10_warc": warc.SQL, "op11_ranked_search": search.SQL}
