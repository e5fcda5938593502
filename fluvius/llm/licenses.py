"""License scans: ordered signature rules over normalised words, gated by keywords, with containment suppression.

Everything runs in one narrow pass of DataFrame expressions: no shuffle, no Python, no state outside the row.

A text is lower-cased and its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` are joined by single spaces. A rule is
``label | priority | score | keyword | pattern``; its pattern is tried only where the keyword occurs, on whole words.
A detection is dropped if its word interval lies inside that of a detection of equal or higher importance (a smaller or
equal priority number); of two equal intervals the more important one, then the earlier rule, stays.

Edge cases: a null or empty text has no words, no detections and score 0; repeated rows give repeated results; a null id is
returned as it is; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvius.llm.arrays import running

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The phrases that always count, with their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_GRANT = "(?:licensed|released|distributed|available|published|provided|redistributed|covered|offered|issued) (?:to you )?(?:under|by|with|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"

#: priority 1: a grant or a license text; 2: a named license; 3: a mention or a family without version.
_NAMED = """
mit;mit licen;mit licen[cs]e
mit;expat;expat license
mit-0;mit no attribution;mit no attribution(?: license)?
mit-0;mit 0;mit 0(?: license)?
x11;x11;x11 license
bsd-2-clause;bsd;(?:simplified|freebsd|2 clause|two clause|new 2 clause) bsd(?: license)?|bsd 2 clause(?: license)?
bsd-3-clause;bsd;(?:modified|revised|new|3 clause|three clause) bsd(?: license)?|bsd 3 clause(?: license)?
bsd-4-clause;bsd;(?:original|4 clause|four clause) bsd(?: license)?|bsd 4 clause(?: license)?
0bsd;0bsd;0bsd
0bsd;zero clause bsd;zero clause bsd(?: license)?
isc;isc;isc license
isc;internet systems consortium;internet systems consortium license
apache-1.1;apache;apache(?: software)? license (?:version |v )?1 1
apache-2;apache;apache(?: software)? license (?:version |v )?2(?: 0)?
apache-2;apache;apache 2(?: 0)?(?: license)?
apache-2;asl;asl 2 0
gpl-1;general public license;gnu general public license (?:version |v)1
gpl-2;general public license;gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)2(?: 0)?
gpl-3;general public license;gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?
gpl-2;gpl;gpl ?(?:version |v)?2(?: 0)?(?: only)?
gpl-3;gpl;gpl ?(?:version |v)?3(?: 0)?(?: only)?
gpl-2+;gpl;gpl ?(?:version |v)?2(?: 0)? or (?:later|any later version|newer)
gpl-3+;gpl;gpl ?(?:version |v)?3(?: 0)? or (?:later|any later version|newer)
gpl-2+;general public license;general public license version 2 or (?:at your option )?any later version
gpl-3+;general public license;general public license version 3 or (?:at your option )?any later version
lgpl-2;library general public license;gnu library general public license (?:version |v)2(?: 0)?
lgpl-2.1;lesser general public license;gnu lesser general public license (?:version |v)2 1
lgpl-3;lesser general public license;gnu lesser general public license (?:version |v)3(?: 0)?
lgpl-2.1;lgpl;lgpl ?(?:version |v)?2 1(?: only)?
lgpl-3;lgpl;lgpl ?(?:version |v)?3(?: 0)?(?: only)?
lgpl-2.1+;lgpl;lgpl ?(?:version |v)?2 1 or (?:later|newer)
agpl-3;affero;(?:gnu )?affero general public license (?:version |v)3(?: 0)?
agpl-1;affero;affero general public license (?:version |v)1(?: 0)?
agpl-3;agpl;agpl ?(?:version |v)?3(?: 0)?
gfdl-1.2;free documentation license;gnu free documentation license (?:version |v)1 2
gfdl-1.3;free documentation license;gnu free documentation license (?:version |v)1 3
gfdl;gfdl;gfdl(?: 1 [123])?
mpl-1.0;mozilla;mozilla public license (?:version |v )?1 0
mpl-1.1;mozilla;mozilla public license (?:version |v )?1 1
mpl-2.0;mozilla;mozilla public license (?:version |v )?2(?: 0)?
mpl-2.0;mpl;mpl ?(?:version |v)?2 0
epl-1.0;eclipse;eclipse public license (?:version |v )?1 0
epl-2.0;eclipse;eclipse public license (?:version |v )?2 0
epl-2.0;epl;epl ?v?2 0
edl-1.0;eclipse;eclipse distribution license (?:version |v )?1 0
cddl-1.0;cddl;cddl ?(?:version |v)?1 0
cddl-1.1;cddl;cddl ?(?:version |v)?1 1
cddl-1.0;common development;common development and distribution license(?: (?:version |v )?1 0)?
cpl-1.0;common public;common public license (?:version |v )?1 0
cpal-1.0;common public attribution;common public attribution license(?: (?:version |v )?1 0)?
eupl-1.1;european union public;european union public licen[cs]e (?:version |v )?1 1
eupl-1.2;european union public;european union public licen[cs]e (?:version |v )?1 2
eupl-1.2;eupl;eupl ?v?1 2
cecill-2.1;cecill;cecill ?(?:version |v)?2 1
cecill-b;cecill;cecill b
cecill-c;cecill;cecill c
artistic-1.0;artistic;artistic license (?:version |v )?1 0
artistic-2.0;artistic;artistic license (?:version |v )?2 0
artistic;perl;same terms as perl(?: 5)?(?: itself)?
zlib;zlib;zlib(?: libpng)? license
libpng;libpng;libpng license
boost-1.0;boost;boost software license(?: (?:version |v )?1 0)?
boost-1.0;bsl;bsl 1 0
busl-1.1;business source;business source license(?: 1 1)?
unlicense;unlicense;(?:the )?unlicense
wtfpl;wtfpl;wtfpl
wtfpl;what the fuck;do what the fuck you want to public license
cc0-1.0;cc0;cc0(?: 1 0)?(?: universal)?
cc0-1.0;creative commons;creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?
cc-pdm;public domain mark;public domain mark(?: 1 0)?
public-domain;public domain;(?:released|placed|dedicated|is) (?:in|into|to|in to) the public domain
public-domain;public domain;public domain dedication
cc-by;cc by;cc by(?: [1234] [05])?
cc-by-sa;cc by;cc by sa(?: [1234] [05])?
cc-by-nd;cc by;cc by nd(?: [1234] [05])?
cc-by-nc;cc by;cc by nc(?: [1234] [05])?
cc-by-nc-sa;cc by;cc by nc sa(?: [1234] [05])?
cc-by-nc-nd;cc by;cc by nc nd(?: [1234] [05])?
cc-by;creative commons;creative commons attribution(?: [1234] [05])?
cc-by-sa;creative commons;creative commons attribution share ?alike(?: [1234] [05])?
cc-by-nd;creative commons;creative commons attribution no ?deriv(?:ative|ative works|s|atives)(?: [1234] [05])?
cc-by-nc;creative commons;creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-nc-sa;creative commons;creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc-nd;creative commons;creative commons attribution non ?commercial no ?deriv(?:ative works|s|atives)(?: [1234] [05])?
cc-by;creativecommons;creativecommons org licenses by
cc-by-sa;creativecommons;creativecommons org licenses by sa
cc-by-nd;creativecommons;creativecommons org licenses by nd
cc-by-nc;creativecommons;creativecommons org licenses by nc
cc-by-nc-sa;creativecommons;creativecommons org licenses by nc sa
cc-by-nc-nd;creativecommons;creativecommons org licenses by nc nd
cc0-1.0;creativecommons;creativecommons org publicdomain zero
cc-pdm;creativecommons;creativecommons org publicdomain mark
odbl-1.0;odbl;odbl(?: 1 0)?
odbl-1.0;open database;open database license(?: v?1 0)?
odc-by-1.0;open data commons;open data commons attribution license(?: v?1 0)?
odc-by-1.0;odc by;odc by(?: 1 0)?
pddl-1.0;pddl;pddl(?: 1 0)?
pddl-1.0;public domain dedication;public domain dedication and license(?: 1 0)?
ogl-uk-1.0;open government;open government licen[cs]e v?1 0
ogl-uk-2.0;open government;open government licen[cs]e v?2 0
ogl-uk-3.0;open government;open government licen[cs]e v?3 0
ogl-canada-2.0;open government;open government licen[cs]e canada
etalab-2.0;licence ouverte;licence ouverte(?: open licence)?(?: 2 0)?
dl-de-by-2.0;datenlizenz;datenlizenz deutschland namensnennung(?: version)? 2 0
dl-de-zero-2.0;datenlizenz;datenlizenz deutschland zero(?: version)? 2 0
cdla-permissive-1.0;cdla;cdla permissive 1 0
cdla-permissive-2.0;cdla;cdla permissive 2 0
cdla-sharing-1.0;cdla;cdla sharing 1 0
openrail;openrail;(?:bigscience )?(?:creativeml )?openrail(?: m)?(?: license)?
openrail;open rail;(?:bigscience )?(?:creativeml )?open rail(?: m)?(?: license)?
bigscience-rail-1.0;bigscience;bigscience rail license(?: 1 0)?
gemma-terms;gemma;gemma terms of use
python-2.0;python;python software foundation license(?: version 2)?
psf-2.0;psf;psf license(?: 2 0)?
cnri-python;cnri;cnri python license
php-3.0;php;php license (?:version |v )?3 0
php-3.01;php;php license (?:version |v )?3 01
ruby;ruby;ruby s? ?licen[cs]e
w3c;w3c;w3c software (?:notice and|and document) license
ofl-1.1;open font;(?:sil )?open font license(?: version)?(?: 1 1)?
ofl-1.1;ofl;ofl 1 1
ofl-1.0;ofl;ofl 1 0
upl-1.0;universal permissive;universal permissive license(?: v?1 0)?
ncsa;ncsa;(?:university of illinois )?ncsa open source license
ecl-2.0;educational community;educational community license(?: (?:version |v )?2 0)?
afl-3.0;academic free;academic free license(?: (?:version |v )?3 0)?
afl-2.1;academic free;academic free license (?:version |v )?2 1
osl-3.0;open software;open software license(?: (?:version |v )?3 0)?
osl-2.1;open software;open software license (?:version |v )?2 1
ms-pl;microsoft;microsoft public license
ms-rl;microsoft;microsoft reciprocal license
ipl-1.0;ibm;ibm public license(?: (?:version |v )?1 0)?
qpl-1.0;q public;q public license(?: (?:version |v )?1 0)?
sspl-1.0;server side public;server side public license(?: (?:version |v )?1)?
sspl-1.0;sspl;sspl ?v?1
elastic-2.0;elastic;elastic license(?: (?:version |v )?2 0)?
commons-clause;commons clause;commons clause(?: license condition)?(?: v?1 0)?
polyform-noncommercial-1.0;polyform;polyform noncommercial license(?: 1 0 0)?
polyform-small-business-1.0;polyform;polyform small business license(?: 1 0 0)?
postgresql;postgresql;postgresql licen[cs]e
curl;curl;curl license
openssl;openssl;openssl license
ssleay;ssleay;ssleay license
tcl;tcl;tcl tk license
vim;vim;vim license
beerware;beer ware;beer ware license
beerware;beerware;beerware license
bittorrent-1.1;bittorrent;bittorrent open source license(?: (?:version |v )?1 1)?
json;json;json license
icu;icu;icu license
unicode-dfs;unicode;unicode(?: data files and software)? license
naist;naist;naist license
intel;intel;intel open source license
nvidia;nvidia;nvidia (?:open model|source code|software) license
llama;llama;llama [234](?: [123])? community license
hpnd;hpnd;hpnd
hpnd;historical permission;historical permission notice and disclaimer
lppl-1.3c;latex project;latex project public license(?: (?:version |v )?1 3c)?
lppl;lppl;lppl(?: 1 [0123]c?)?
mulan-psl-2;mulan;mulan (?:psl|permissive software license)(?: ?(?:version |v)?2)?
blueoak-1.0;blue oak;blue oak model license(?: 1 0 0)?
cern-ohl;cern;cern open hardware licen[cs]e
taptapr;tapr;tapr open hardware license
sleepycat;sleepycat;sleepycat license
vsl-1.0;vovida;vovida software license(?: (?:version |v )?1 0)?
zpl-2.1;zope;zope public license(?: (?:version |v )?2 1)?
xfree86;xfree86;xfree86 license(?: 1 1)?
apsl-2.0;apple public;apple public source license(?: (?:version |v )?2 0)?
rpl-1.5;reciprocal public;reciprocal public license(?: 1 5)?
nosl;netizen;netizen open source license
spdx-mit;spdx;spdx license identifier mit
spdx-apache;spdx;spdx license identifier apache 2 0
spdx-gpl;spdx;spdx license identifier (?:a|l)?gpl [123] [01](?: only| or later)?
spdx-bsd;spdx;spdx license identifier bsd [234] clause
spdx-mpl;spdx;spdx license identifier mpl [12] [01]
"""

#: label;score;keyword;pattern of license texts and grants (priority 1).
_TEXTS = """
mit;0.95;permission is hereby granted;permission is hereby granted free of charge to any person obtaining a copy of this software
mit;0.9;above copyright notice;the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit;0.6;as is;the software is provided as is without warranty of any kind express or implied
isc;0.95;permission to use;permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd;0.8;redistribution and use;redistribution and use in source and binary forms with or without modification are permitted
bsd;0.6;redistributions;redistributions of source code must retain the above copyright notice
bsd;0.6;redistributions;redistributions in binary form must reproduce the above copyright notice
bsd-3-clause;0.9;endorse or promote;may be used to endorse or promote products derived from this software
bsd-4-clause;0.9;advertising materials;all advertising materials mentioning features or use of this software must display
apache-2;0.9;apache org;you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0
apache-2;0.7;required by applicable law;unless required by applicable law or agreed to in writing software distributed under the license
gpl;0.8;redistribute it;you can redistribute it and or modify it under the terms of the gnu general public license
gpl;0.6;general public license;you should have received a copy of the gnu general public license
lgpl;0.8;lesser general public license;you can redistribute it and or modify it under the terms of the gnu lesser general public license
gpl;0.6;fitness for a particular purpose;without even the implied warranty of merchantability or fitness for a particular purpose
mpl;0.8;source code form;this source code form is subject to the terms of the mozilla public license
zlib;0.9;altered source;altered source versions must be plainly marked as such
zlib;0.9;misrepresented;the origin of this software must not be misrepresented
unlicense;0.95;unencumbered;this is free and unencumbered software released into the public domain
beerware;0.9;buy me a beer;you can buy me a beer in return
cc0-1.0;0.9;waived all copyright;has waived all copyright and related or neighboring rights
wtfpl;0.9;you just do;you just do what the fuck you want to
sspl-1.0;0.8;as a service;offer the program as a service to third parties you must make the service source code available
proprietary;0.8;all rights reserved;all rights reserved
proprietary;0.8;confidential;confidential and proprietary
proprietary;0.7;unauthorized;unauthorized (?:copying|reproduction|use|distribution) (?:of this (?:file|work|document) )?(?:is|via any medium is) (?:strictly )?prohibited
non-commercial;0.7;noncommercial;(?:for )?noncommercial (?:use|purposes) only
non-commercial;0.7;non commercial;(?:for )?non commercial (?:use|purposes) only
non-commercial;0.7;commercial;not for commercial use
research-only;0.7;research;for research (?:use|purposes) only
no-derivatives;0.6;derivative;no derivative works (?:are )?(?:permitted|allowed)
share-alike;0.6;same license;distribute your contributions under the same license
"""

#: label;keyword;pattern of bare mentions (priority 3).
_MENTIONS = """
apache;apache;apache license
gpl;gpl;gpl
gpl;general public license;(?:gnu )?general public license
lgpl;lgpl;lgpl
lgpl;lesser general public license;(?:gnu )?lesser general public license
agpl;agpl;agpl
agpl;affero;affero general public license
mpl;mozilla;mozilla public license
epl;eclipse;eclipse public license
bsd;bsd;bsd (?:style )?licen[cs]e
artistic;artistic;artistic license
creative-commons;creative commons;creative commons(?: licen[cs]e)?
cddl;cddl;cddl
eupl;eupl;eupl
open-government;open government;open government licen[cs]e
"""


def _rules() -> list[tuple[str, int, float, str, str]]:
    out = []
    for line in filter(None, _TEXTS.splitlines()):
        label, score, word, pattern = line.split(";")
        out.append((label, 1, float(score), word, pattern))
    for line in filter(None, _NAMED.splitlines()):
        label, word, pattern = line.split(";")
        if word not in ("spdx", "creativecommons", "public domain"):
            out.append((label, 1, 0.95, word, f"{_GRANT}(?:{pattern})"))
        out.append((label, 2, 0.8, word, pattern))
    for line in filter(None, _MENTIONS.splitlines()):
        label, word, pattern = line.split(";")
        out.append((label, 3, 0.4, word, pattern))
    return out


RULES = _rules()


#: Beyond A-Z two characters have a lower case with ASCII letters: U+212A and U+0130.
_ODD = ("\u212a", "\u0130")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """The text (null: empty) with A-Z lower-cased. Letters beyond ASCII may be too, which are in no rule; they stay letters."""
    given = F.coalesce(text, F.lit(""))
    odd = F.contains(given, F.lit(_ODD[0])) | F.contains(given, F.lit(_ODD[1]))
    return F.when(odd, F.translate(given, _UPPER, _UPPER.lower())).otherwise(F.lower(given))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _trie(words: list[str]) -> str:
    """A regex for any of ``words`` that decides letter by letter, so that a scan fails at the first wrong letter."""
    if "" in words:
        return ""
    heads = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    parts = [h + _trie(rest) for h, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _rule_table() -> Column:
    """The rules as a constant array; one literal, as a thousand small ones take seconds to plan."""
    rows = [{"i": i, "prio": p, "score": s, "label": label, "word": w, "pat": f"(?<= )(?:{x})(?= )"} for i, (label, p, s, w, x) in enumerate(RULES)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<i:int,prio:int,score:double,label:string,word:string,pat:string>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, base places, and ``detections`` array<struct<label, start, end, priority, score>>
    (word intervals, end exclusive, in text order) after suppression."""
    body = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(F.col(text_col)), SEPARATORS, " ")), F.lit(" "))
    df = docs.select(F.col(id_col).alias("doc_id"), body.alias("_body"))
    keywords = sorted({r[3] for r in RULES} | {"under the mit license", "apache license version 2", "cc by nc"})
    body = F.col("_body")
    # one linear pass finds the texts with any keyword; only there are the keywords told apart and their rules tried
    present = F.filter(F.split(F.lit("|".join(keywords)), r"\|"), lambda k: F.contains(body, F.concat(F.lit(" "), k)))
    df = df.select("doc_id", "_body", F.when(body == "  ", F.lit(0)).otherwise(_spaces(body) - 1).cast("long").alias("n_words"), F.when(F.rlike(body, F.lit(" " + _trie(keywords))), present).alias("_present"))
    any_rule = F.col("_present").isNotNull()

    pieces = F.split(F.regexp_replace(body, f"(?<= )(?:{'|'.join(BASE)})(?= )", "\u0001$0"), "\u0001")
    df = df.withColumn("_pieces", F.when(any_rule, pieces))
    n_base = F.coalesce(F.size("_pieces") - 1, F.lit(0))
    found = F.col("_pieces").isNotNull() & (F.size("_pieces") > 1)
    base_labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(found & F.contains(body, F.lit(f" {k} ")), F.lit(v)) for k, v in BASE.items()]), lambda x: x.isNotNull())))

    def spans(r: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(body, r["pat"], F.lit("\u0001$0\u0002"))), " ")
        starts = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit("\u0001")), i)), lambda x: x.isNotNull())
        ends = F.filter(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit("\u0002")), i + 1)), lambda x: x.isNotNull())
        return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.struct(z["s"].alias("start"), (-z["e"]).alias("neg_end"), r["prio"].alias("priority"), r["i"].alias("rule"), r["label"].alias("label"), r["score"].alias("score")))

    tried = F.filter(_rule_table(), lambda r: F.array_contains(F.col("_present"), r["word"]) & F.rlike(body, r["pat"]))
    df = df.withColumn("_all", F.when(any_rule, F.array_sort(F.flatten(F.transform(tried, spans)))))

    # in order (start, longer first, more important first) a detection is contained iff an earlier one reaches as far
    kept_type = "array<struct<label:string,start:int,end:int,priority:int,score:double>>"
    told_type = kept_type.replace("double", "double,inside:boolean")

    def step(m: Column, d: Column) -> Column:
        end, p = -d["neg_end"], d["priority"]
        return F.struct(F.when(p <= 1, F.greatest(m["m1"], end)).otherwise(m["m1"]).alias("m1"), F.when(p <= 2, F.greatest(m["m2"], end)).otherwise(m["m2"]).alias("m2"), F.greatest(m["m3"], end).alias("m3"))

    def one(m: Column, d: Column) -> Column:
        end, p = -d["neg_end"], d["priority"]
        reach = F.when(p == 1, m["m1"]).when(p == 2, m["m2"]).otherwise(m["m3"])
        return F.struct(d["label"].alias("label"), d["start"].alias("start"), end.alias("end"), p.alias("priority"), d["score"].alias("score"), (reach >= end).alias("inside"))

    zero = F.struct(*[F.lit(-1).alias(m) for m in ("m1", "m2", "m3")])
    told = F.filter(running(F.col("_all"), zero, step, one, told_type), lambda x: ~x["inside"])
    kept = F.coalesce(F.when(F.size("_all") > 0, F.transform(told, lambda x: x.dropFields("inside"))), F.array().cast(kept_type))
    return df.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        F.when(found, _spaces(F.col("_pieces")[0]) - 1).cast("long").alias("first_word"),
        F.when(found, _spaces(body) - _spaces(F.element_at("_pieces", -1)) - 1).cast("long").alias("last_word"),
        base_labels.alias("base_labels"), kept.alias("detections"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``'s rows."""
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base_labels"), F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, F.greatest(best, F.lit(0.95))).otherwise(best).alias("score"), F.size("detections").cast("long").alias("n_detections"))
