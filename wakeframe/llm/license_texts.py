"""Templates of common licenses: permission texts, headers, openings and wordings of short notices (fixed values).

An id is a license, or a family of them, and the kind of notice after a colon. An apostrophe is written as a
space, which gives the same words.
"""

TEXTS = {
    "mit:permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-or-0bsd:permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd:conditions-and-disclaimer": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause:endorsement": (
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "zlib:permission": (
        "This software is provided as-is , without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
        "altered from any source distribution."
    ),
    "boost-1.0:permission": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
        "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative "
        "works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated "
        "by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL "
        "THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "unlicense:text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non- "
        "commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large "
        "and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of "
        "all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "apache-2.0:header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
        "License."
    ),
    "apache-2.0:opening": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
        "DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by "
        "Sections 1 through 9 of this document."
    ),
    "gnu:header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU "
        "General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "gpl:terms": "under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gnu:library-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This "
        "library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have "
        "received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, "
        "Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
    ),
    "lgpl:terms": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl:library-terms": "under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "agpl:terms": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "gnu:version-2": "Foundation, either version 2 of the License",
    "gnu:version-2.1": "Foundation, either version 2.1 of the License",
    "gnu:version-3": "Foundation, either version 3 of the License",
    "gpl-2.0:opening": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3.0:opening": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone "
        "is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU "
        "General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other "
        "practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License "
        "is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all "
        "its users."
    ),
    "lgpl-2.1:opening": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin "
        "Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license "
        "document, but changing it is not allowed. [This is the first released version of the Lesser GPL. It also counts as the successor "
        "of the GNU Library Public License, version 2, hence the version number 2.1.] Preamble The licenses for most software are designed "
        "to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your "
        "freedom to share and change free software--to make sure the software is free for all its users."
    ),
    "lgpl-3.0:opening": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This "
        "version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public "
        "License, supplemented by the additional permissions listed below."
    ),
    "agpl-3.0:opening": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble "
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to "
        "ensure cooperation with the community in the case of network server software."
    ),
    "mpl-2.0:header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "mpl-2.0:opening": (
        "Mozilla Public License Version 2.0  1. Definitions -- 1.1. \"Contributor\" means each individual or legal entity that creates, "
        "contributes to the creation of, or owns Covered Software."
    ),
    "cc0-1.0:text": (
        "Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related "
        "Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship "
        "and/or a database (each, a \"Work\"). Certain owners wish to permanently relinquish those rights to a Work for the purpose of "
        "contributing to a commons of creative, cultural and scientific works (\"Commons\") that the public can reliably and without fear of "
        "later claims of infringement build upon, modify, incorporate in other works, reuse and redistribute as freely as possible in any "
        "form whatsoever and for any purposes, including without limitation commercial purposes. These owners may contribute to the Commons "
        "to promote the ideal of a free culture and the further production of creative, cultural and scientific works, or to gain "
        "reputation or greater distribution for their Work in part through the use and efforts of others. For these and/or other purposes "
        "and motivations, and without any expectation of additional consideration or compensation, the person associating CC0 with a Work "
        "(the \"Affirmer\"), to the extent that he or she is an owner of Copyright and Related Rights in the Work, voluntarily elects to "
        "apply CC0 to the Work and publicly distribute the Work under its terms, with knowledge of his or her Copyright and Related Rights "
        "in the Work and the meaning and intended legal effect of CC0 on those rights. 1. Copyright and Related Rights. A Work made "
        "available under CC0 may be protected by copyright and related or neighboring rights (\"Copyright and Related Rights\"). Copyright "
        "and Related Rights include, but are not limited to, the following: i. the right to reproduce, adapt, distribute, perform, display, "
        "communicate, and translate a Work; ii. moral rights retained by the original author(s) and/or performer(s); iii. publicity and "
        "privacy rights pertaining to a person s image or likeness depicted in a Work; iv. rights protecting against unfair competition in "
        "regards to a Work, subject to the limitations in paragraph 4(a), below; v. rights protecting the extraction, dissemination, use "
        "and reuse of data in a Work; vi. database rights (such as those arising under Directive 96/9/EC of the European Parliament and of "
        "the Council of 11 March 1996 on the legal protection of databases, and under any national implementation thereof, including any "
        "amended or successor version of such directive); and vii. other similar, equivalent or corresponding rights throughout the world "
        "based on applicable law or treaty, and any national implementations thereof. 2. Waiver. To the greatest extent permitted by, but "
        "not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, "
        "abandons, and surrenders all of Affirmer s Copyright and Related Rights and associated claims and causes of action, whether now "
        "known or unknown (including existing as well as future claims and causes of action), in the Work (i) in all territories worldwide, "
        "(ii) for the maximum duration provided by applicable law or treaty (including future time extensions), (iii) in any current or "
        "future medium and for any number of copies, and (iv) for any purpose whatsoever, including without limitation commercial, "
        "advertising or promotional purposes (the \"Waiver\"). Affirmer makes the Waiver for the benefit of each member of the public at "
        "large and to the detriment of Affirmer s heirs and successors, fully intending that such Waiver shall not be subject to "
        "revocation, rescission, cancellation, termination, or any other legal or equitable action to disrupt the quiet enjoyment of the "
        "Work by the public as contemplated by Affirmer s express Statement of Purpose. 3. Public License Fallback. Should any part of the "
        "Waiver for any reason be judged legally invalid or ineffective under applicable law, then the Waiver shall be preserved to the "
        "maximum extent permitted taking into account Affirmer s express Statement of Purpose. In addition, to the extent the Waiver is so "
        "judged Affirmer hereby grants to each affected person a royalty-free, non transferable, non sublicensable, non exclusive, "
        "irrevocable and unconditional license to exercise Affirmer s Copyright and Related Rights in the Work (i) in all territories "
        "worldwide, (ii) for the maximum duration provided by applicable law or treaty (including future time extensions), (iii) in any "
        "current or future medium and for any number of copies, and (iv) for any purpose whatsoever, including without limitation "
        "commercial, advertising or promotional purposes (the \"License\"). The License shall be deemed effective as of the date CC0 was "
        "applied by Affirmer to the Work. Should any part of the License for any reason be judged legally invalid or ineffective under "
        "applicable law, such partial invalidity or ineffectiveness shall not invalidate the remainder of the License, and in such case "
        "Affirmer hereby affirms that he or she will not (i) exercise any of his or her remaining Copyright and Related Rights in the Work "
        "or (ii) assert any associated claims and causes of action with respect to the Work, in either case contrary to Affirmer s express "
        "Statement of Purpose. 4. Limitations and Disclaimers. a. No trademark or patent rights held by Affirmer are waived, abandoned, "
        "surrendered, licensed or otherwise affected by this document. b. Affirmer offers the Work as-is and makes no representations or "
        "warranties of any kind concerning the Work, express, implied, statutory or otherwise, including without limitation warranties of "
        "title, merchantability, fitness for a particular purpose, non infringement, or the absence of latent or other defects, accuracy, "
        "or the present or absence of errors, whether or not discoverable, all to the greatest extent permissible under applicable law. c. "
        "Affirmer disclaims responsibility for clearing rights of other persons that may apply to the Work or any use thereof, including "
        "without limitation any person s Copyright and Related Rights in the Work. Further, Affirmer disclaims responsibility for obtaining "
        "any necessary consents, permissions or other rights required for any use of the Work."
    ),
    "cc-by-4.0:opening": "Creative Commons Attribution 4.0 International Public License",
    "cc-by-4.0:name": "Creative Commons Attribution 4.0 International License",
    "cc-by-4.0:short": "under CC BY 4.0",
    "cc-by-3.0:name": "Creative Commons Attribution 3.0",
    "cc-by-sa-4.0:opening": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "cc-by-sa-4.0:name": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-sa-4.0:short": "under CC BY-SA 4.0",
    "cc-by-sa-3.0:name": "Creative Commons Attribution-ShareAlike 3.0",
    "cc-by-nc-4.0:opening": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "cc-by-nc-4.0:name": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-4.0:short": "under CC BY-NC 4.0",
    "cc-by-nc-3.0:name": "Creative Commons Attribution-NonCommercial 3.0",
    "cc-by-nd-4.0:opening": "Creative Commons Attribution-NoDerivatives 4.0 International Public License",
    "cc-by-nd-4.0:name": "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nd-4.0:short": "under CC BY-ND 4.0",
    "cc-by-nd-3.0:name": "Creative Commons Attribution-NoDerivatives 3.0",
    "cc-by-nc-sa-4.0:opening": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License",
    "cc-by-nc-sa-4.0:name": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-sa-4.0:short": "under CC BY-NC-SA 4.0",
    "cc-by-nc-sa-3.0:name": "Creative Commons Attribution-NonCommercial-ShareAlike 3.0",
    "cc-by-nc-nd-4.0:opening": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License",
    "cc-by-nc-nd-4.0:name": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "cc-by-nc-nd-4.0:short": "under CC BY-NC-ND 4.0",
    "cc-by-nc-nd-3.0:name": "Creative Commons Attribution-NonCommercial-NoDerivatives 3.0",
    "cc-4.0:terms": (
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative "
        "Commons"
    ),
    "mit:licensed": "licensed under the MIT License",
    "mit:distributed": "distributed under the MIT License",
    "mit:available": "available under the MIT License",
    "mit:provided": "provided under the MIT License",
    "mit:terms": "under the terms of the MIT License",
    "mit:title": "The MIT License (MIT)",
    "mit:copyright": "MIT License Copyright (c)",
    "isc:title": "ISC License Copyright (c)",
    "isc:licensed": "under the ISC License",
    "apache-2.0:without-version": "under the Apache License 2.0",
    "apache-2.0:v2": "under the Apache License v2.0",
    "bsd-2-clause:licensed": "under the BSD 2-Clause License",
    "bsd-3-clause:licensed": "under the BSD 3-Clause License",
    "bsd:licensed": "under the BSD License",
    "gpl-2.0:as-published": "GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-2.0:version": "GNU General Public License version 2",
    "gpl-2.0:v": "GNU General Public License v2.0",
    "gpl-2.0:v-short": "under the GPLv2",
    "gpl-3.0:version": "GNU General Public License version 3",
    "gpl-3.0:v": "GNU General Public License v3.0",
    "gpl-3.0:v-short": "under the GPLv3",
    "lgpl-2.1:version": "GNU Lesser General Public License version 2.1",
    "lgpl-2.1:v": "GNU Lesser General Public License v2.1",
    "lgpl-2.1:v-short": "under the LGPLv2.1",
    "lgpl-3.0:version": "GNU Lesser General Public License version 3",
    "lgpl-3.0:v": "GNU Lesser General Public License v3.0",
    "lgpl-3.0:v-short": "under the LGPLv3",
    "agpl-3.0:version": "GNU Affero General Public License version 3",
    "agpl-3.0:v": "GNU Affero General Public License v3.0",
    "agpl-3.0:v-short": "under the AGPLv3",
    "mpl-2.0:licensed": "under the Mozilla Public License 2.0",
    "mpl-2.0:version": "under the Mozilla Public License, version 2.0",
    "unlicense:public-domain": "released into the public domain",
    "cc0-1.0:name": "CC0 1.0 Universal",
    "mit:spdx": "SPDX-License-Identifier: MIT",
    "isc:spdx": "SPDX-License-Identifier: ISC",
    "apache-2.0:spdx": "SPDX-License-Identifier: Apache-2.0",
    "bsd-2-clause:spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd-3-clause:spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "0bsd:spdx": "SPDX-License-Identifier: 0BSD",
    "zlib:spdx": "SPDX-License-Identifier: Zlib",
    "bsl-1.0:spdx": "SPDX-License-Identifier: BSL-1.0",
    "unlicense:spdx": "SPDX-License-Identifier: Unlicense",
    "gpl-2.0:spdx": "SPDX-License-Identifier: GPL-2.0",
    "gpl-3.0:spdx": "SPDX-License-Identifier: GPL-3.0",
    "lgpl-2.1:spdx": "SPDX-License-Identifier: LGPL-2.1",
    "lgpl-3.0:spdx": "SPDX-License-Identifier: LGPL-3.0",
    "agpl-3.0:spdx": "SPDX-License-Identifier: AGPL-3.0",
    "mpl-2.0:spdx": "SPDX-License-Identifier: MPL-2.0",
    "cc0-1.0:spdx": "SPDX-License-Identifier: CC0-1.0",
    "cc-by-4.0:spdx": "SPDX-License-Identifier: CC-BY-4.0",
    "cc-by-sa-4.0:spdx": "SPDX-License-Identifier: CC-BY-SA-4.0",
    "cc-by-nc-4.0:spdx": "SPDX-License-Identifier: CC-BY-NC-4.0",
}
