"""License scans: entire texts, in a canonical form, hash-joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlinelake.llm.common import text_or_empty

#: Known digests that are broadcast; more are joined by a shuffle of digests.
SMALL = 10_000

# Pairs of spellings that licence matching treats as the same word (left becomes right).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber",
    "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "copyright owner": "copyright holder", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "wilfull", "https": "http",
}

# The texts of short licences, copyright lines left out.
_BSD_TERMS = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
KNOWN = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": f"{_BSD_TERMS} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_TERMS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


# Digests of the canonical forms of longer licences as published, and of those with an appendix also
# without it; each with its lines and as one line.
DIGESTS = {
    "Apache-2.0": [
        "a288756d2163334a44ac8890b91176c80e874e0d08c2ac9635ddb9fbe59b168d",
        "92ce29ea7f83a01d7d4691d8e63128e9ae5905ed8b0849c6a8526e7a2c2fe71d",
        "cbd5b28ce203cc5c53238d4c298a70ca86737c286e9c707f77fa5a97b33b606c",
        "a1c987210d3b09d59f4e972b299ed2f1f7e2a4714c2db30d7759c3e69ca502f3",
        "3b9d85a2db4dd4ceb03289043a41619c5981dc1862c71d2d27902ab3fc9436fc",
        "809f9bc8108a4ee2f1da1d286a66bc705dbdb9dcbcce2fe69fc504aa06e8af08",
    ],
    "Artistic-1.0-Perl": [
        "605e60098b41000a8ac1cb87343cfd8399e2ac1e421e6d7cd712adfc7e27b7bf",
        "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49",
    ],
    "CC0-1.0": [
        "8ae1e942eac0fe86c7104b33e311c7b30e78c5c651bcb28e96cb535b7a413552",
    ],
    "GFDL-1.2": [
        "916f90dfede4440db57d33750117284ce52e6ab12b285999383af4ffce1972e1",
        "cb74ce7218aba6fef673445e953a9006b368b501ffbe158e428810951cb8fc2e",
    ],
    "GFDL-1.3": [
        "6f0442a7e912b74386d661d0ee55082d9b6302e5764bee6cc93b9fc300343506",
        "f3a989d18a671fe5198b54ab2d9aac8509f3acb38e02e9495f8c41faa5f4d111",
    ],
    "GPL-1.0": [
        "fc578b143f673bbb1d326f3f50a0ba64f4c1523fcb882d44a0332f45afe20e37",
        "36357e6544e397bac93691fc52b5bb21356b2addc838a221bcb5d9ec00d944e2",
        "a29689a672c02faeb16f89c0f42c2ade8d25a0b174b39e60e8920375ed6077f5",
        "7723de0a299066a95778c1038bf6f09f668a241d1176759ecb70074b9aaf81b3",
        "9474ac755af0a47fc3b37f4cd54b23fafd80982767fc401a8951d8f5707f595b",
        "cd2c7dbdae5c44782142ee46fd64bf5a32a45e0520a709d2e770936849f431e3",
    ],
    "GPL-2.0": [
        "58eb187c3529e82abae5806c8a660728fd1d57c4acbc5e6a1e0da045931addbe",
        "085ed894a877aef6415451ab272cdbaa31d698791ed6f385d0d57a29899b7c5a",
        "57b7c99e491b84bfbab70da489dcfa2436ad58b7f0665ac9b6a42c4575444edf",
        "eb4c9a66d55e61d8c11113d4991bf56ac6124d41b3df7f4cedf0a338fdcb8073",
        "19ac3f3b76ee19ebedc44b38e5e0589370fbfc2c3a51464a4b0fb7e2f81d7fdd",
        "f494bf5440aa62fe74ecab9e03b07915af2070cc9208b9c072dae4c789a56f98",
    ],
    "GPL-3.0": [
        "79a240148d6affd679c8ce9001362ed7db33f07a9adf3f748bd2e569c4b26503",
        "6c92a89bd283689f537fa9a79b5d3f9040e4067f5d744e9b7dd6cae28e814bf6",
        "b9217eb75af326766fb47caa27a021de5b37c4ffceacbf0df56ee7928bf62750",
        "f07cb713dfb664f4255b3eeead0197eaf9864f6043549a7d64ea9c2594f4ca41",
        "1407ca1cd13936e60f29f3f8b9c4982dfb26946c8d7bfd29ca83c0985f9956f7",
        "96bbcec475254bb528ec580c4f721dc2616df6b5a39648f60ed2218fb304cb8d",
    ],
    "LGPL-2.0": [
        "ea33ed3f3a4d92e3526f2a40eecdc8973abf5d22977b0357f57f0ac9ebba6e37",
        "998576551157604cff74ce32b2864de33dcb38f38c912b8d03d88e9ea4f9425d",
        "c9d089a065169761194597351f79935675252a3397eda8f1ae07026044cdb60e",
        "0f82f2c79239cea8bfa5bb0ee4858665366230bb74d6d8c5e5247bc43af90cd9",
        "9e38d196e3b47dcf9ace530e9acd02a6372fab3759e418879eb68721e6084f01",
        "95d143d4c2790365d454f8fe0107067a76247137fcde6b357eda043f61aa51d6",
    ],
    "LGPL-2.1": [
        "2fa272556714f0a3b0c23bf5a5aa29f37aa0bca47ab4ef957006ca8d7cfbea6e",
        "92ad43ba58996a356769e4c2ad661ebf360730fb4f4006770fd08d2d4b4ce745",
        "f165e3ad632fabf07e64f61a734b763fa143b44928ced0331091c30e5f483ef9",
        "c968f3259a3fab94a3983539fa08f86cc77dd7e883c9e20d272b4c877d853ac8",
        "8a35755dc06ee32fc358732f8d89a0a5569681311e5b651aed1c4a191b8d7191",
        "c7e687ba1ff3665cffdf90720614795f8e31ff649c6fa8c3835d4fb023833a79",
    ],
    "LGPL-3.0": [
        "1e0c111521caea0af55c9ba20c71d4eb4e955b8d00d6c6ef080c8f944dd6fc90",
        "50fc4b4c9deb165758eeea8383affe76a40d588df1ee12ac362a3373387139b7",
    ],
    "MPL-1.1": [
        "d8c3eec81a2caebbd0029de217dc849bb59c7eeebaa36971c8162cf29b20e7d3",
        "943fb1eac2a6fe8ed7270c6682568a13f47c9bacef069101522ba3ab76567782",
    ],
    "MPL-2.0": [
        "13b52a293c092e5f86b2c4f2f93db6ca35c0b9cc61dfc428e7fbb610e22fc463",
        "39ff04ab69d039b807707491c7408a63cbde06dfedb43de19de1426f71cd1df1",
    ],
    "BSD-3-Clause-Regents": [
        "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060",
    ],
}


# Blanks, and the words that after "copyright" make it a part of a sentence, no notice.
_BLANK = r"[\t\n\f\r ]"
_TERMS = "notices?|holders?|owners?|licen[cs]es?|laws?|statements?|disclaimers?|interests?|permissions?|protection|rights?|treaty|infringement|and|or|in|is|on|to|of|the software"
# How licences begin that are often stored as one line, after their title and notice.
_OPENINGS = "permission is hereby granted|permission to use|redistribution and use|this software is provided"
#: The steps of the canonical form before punctuation goes: pattern and replacement, \\1 and \\2 being groups.
STEPS = [
    (rf"(?i)(^|[^\p{{L}}\p{{N}}])copyright{_BLANK}+({_TERMS})", r"\1copyright_\2"),  # keep what isn't a notice from the next steps
    (rf"(?im)^[^\n]{{0,100}}?copyright[^_\n][^\n]{{0,200}}?({_OPENINGS})", r"\1"),
    (r"(?im)^[^\p{L}\p{N}\n(]*(copyright($|[^_\p{L}\p{N}])|\(c\) *(copyright|[0-9]{4})|©|all rights reserved)[^\n]{0,200}$", " "),
    (r"(?i)^[^\p{L}\p{N}]*[^\n]{0,60}licen[cs]e[^\n]{0,40}\n", " "),  # a title
    (rf"(?im)(^|{_BLANK})(([0-9]{{1,2}}(\.[0-9]{{1,2}})*[.)]|\([a-z0-9]{{1,3}}\)|[a-z][.)]){_BLANK}+)+", " "),  # list marks
]
PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, without title, copyright lines, list marks and punctuation, with one spelling of equivalent words."""
    for pattern, new in STEPS:
        text = F.regexp_replace(text, pattern, new.replace("\\", "$"))
    words = F.trim(F.regexp_replace(F.lower(text), PUNCTUATION, " "))
    one = words
    for other, word in SPELLINGS.items():
        one = F.regexp_replace(one, rf"\b{other}\b", word)
    return F.when(words.rlike(rf"\b({'|'.join(SPELLINGS)})\b"), one).otherwise(words)


def digests_of(texts: DataFrame) -> DataFrame:
    """(digest, license_id) of a table (license_id, text); two texts of one canonical form keep the first id."""
    return texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN, digests: dict[str, list[str]] = DIGESTS) -> DataFrame:
    """(digest, license_id) of the known texts and of further licences known by their digests; digests_of() gives more of them from a table."""
    own = digests_of(spark.createDataFrame(sorted(known.items()), "license_id string, text string"))
    rows = [(d, name) for name, some in sorted(digests.items()) for d in some]
    return own.unionByName(spark.createDataFrame(rows, own.schema)).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest of the whole text's canonical form, and license_id (null: not a known licence's text).

    docs: doc_id and text; other columns are ignored. Null text counts as empty, which is no licence. Repeated rows come
    out as often as they came in; an empty table gives no rows. `known` has (digest, license_id), a digest once; it is
    broadcast if it has at most SMALL rows.
    """
    if known.limit(SMALL + 1).count() <= SMALL:
        known = F.broadcast(known)
    texts = docs.select("doc_id", F.sha2(canonical(text_or_empty()), 256).alias("digest"))
    return texts.join(known, "digest", "left").select("doc_id", "digest", "license_id")
