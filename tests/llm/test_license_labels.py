"""What people write for licenses, and the labels it stands for: a version only where the text states one."""

from sitesieve.llm import license_scan as L

NAMES = [
    ('Released under the Apache License, Version 1.0.', 'apache-1.0'),
    ('Licensed under the Apache License 1.0', 'apache-1.0'),
    ('Licensed under the Apache License, Version 2.0 (the "License")', 'apache-2.0'),
    ('Apache License', 'apache'),
    ('Apache Software License 1.1', 'apache-1.1'),
    ('Artistic License 1.0', 'artistic-1.0'),
    ('Artistic License', 'artistic'),
    ('GNU Free Documentation License, Version 1.1', 'gfdl-1.1'),
    ('license: MIT', 'mit'),
    ('"license": "MIT"', 'mit'),
    ('License: MIT-0', 'mit-0'),
    ('license = Apache-2.0', 'apache-2.0'),
    ('CC BY-SA 2.5', 'cc-by-sa-2.5'),
    ('CC BY 4.0', 'cc-by-4.0'),
    ('CC-BY-NC-ND 3.0', 'cc-by-nc-nd-3.0'),
    ('Creative Commons Attribution 2.0', 'cc-by-2.0'),
    ('Creative Commons Attribution-ShareAlike 4.0 International', 'cc-by-sa-4.0'),
    ('Creative Commons Zero', 'cc0'),
    ('CC0 1.0', 'cc0-1.0'),
    ('AFL-2.1', ''),
    ('Academic Free License 2.1', 'afl-2.1'),
    ('Open Software License v. 1.1', 'osl-1.1'),
    ('ZPL', ''),
    ('Zope Public License 2.0', 'zpl-2.0'),
    ('Mozilla Public License 1.0', 'mpl-1.0'),
    ('Mozilla Public License, v. 2.0', 'mpl-2.0'),
    ('MPL 2.0', 'mpl-2.0'),
    ('Eclipse Public License', 'epl'),
    ('Eclipse Public License - v 2.0', 'epl-2.0'),
    ('GNU General Public License', 'gpl'),
    ('GNU General Public License version 2 or later', 'gpl-2.0'),
    ('GPLv3', 'gpl-3.0'),
    ('licensed under GPLv2', 'gpl-2.0'),
    ('GPL-3.0-or-later', 'gpl-3.0'),
    ('GNU Affero General Public License', 'agpl'),
    ('AGPL v3', 'agpl-3.0'),
    ('LGPL 2.1', 'lgpl-2.1'),
    ('LGPL 2', 'lgpl-2.0'),
    ('GNU Lesser General Public License, version 3', 'lgpl-3.0'),
    ('SPDX-License-Identifier: GPL-2.0-only', 'gpl-2.0'),
    ('SPDX-License-Identifier: AFL-2.1', 'afl-2.1'),
    ('https://www.gnu.org/licenses/gpl-3.0.html', 'gpl-3.0'),
    ('https://www.gnu.org/licenses/gpl.html', 'gpl'),
    ('http://creativecommons.org/licenses/by-sa/2.5/', 'cc-by-sa-2.5'),
    ('http://creativecommons.org/licenses/by-sa/', 'cc-by-sa'),
    ('PHP License 3.01', 'php-3.01'),
    ('PHP License', 'php'),
    ('European Union Public Licence 1.1', 'eupl-1.1'),
    ('GPL 2.5', ''),
    ('Apache License 2.0.1', 'apache'),
    ('Apache License 20', 'apache'),
    ('MIT License', 'mit'),
    ('Boost Software License', 'bsl'),
    ('Distributed under the Boost Software License, Version 1.0.', 'bsl-1.0'),
    ('Educational Community License', 'ecl'),
    ('Educational Community License, Version 2.0', 'ecl-2.0'),
    ('Common Public License 1.0', 'cpl-1.0'),
    ('IBM Public License', 'ipl'),
    ('IBM Public License Version 1.0', 'ipl-1.0'),
    ('Common Development and Distribution License', 'cddl'),
    ('Common Development and Distribution License, Version 1.1', 'cddl-1.1'),
    ('CDDL 1.0', 'cddl-1.0'),
    ('CDDL-1.1', 'cddl-1.1'),
    ('CeCILL license', 'cecill'),
    ('CeCILL Free Software License 2.0', 'cecill-2.0'),
    ('CeCILL License 2.1', 'cecill-2.1'),
    ('Open Database License', 'odbl'),
    ('Open Database License v1.0', 'odbl-1.0'),
    ('ODbL 1.0', 'odbl-1.0'),
    ('SIL Open Font License', 'ofl'),
    ('SIL Open Font License 1.1', 'ofl-1.1'),
    ('OFL 1.1', 'ofl-1.1'),
    ('Python Software Foundation License', 'psf'),
    ('Python Software Foundation License version 2', 'psf-2.0'),
    ('Server Side Public License', 'sspl'),
    ('Server Side Public License v1', 'sspl-1.0'),
    ('SSPL-1.0', 'sspl-1.0'),
    ('Elastic License', 'elastic'),
    ('Elastic License 2.0', 'elastic-2.0'),
    ('Business Source License', 'busl'),
    ('Business Source License 1.1', 'busl-1.1'),
    ('BUSL-1.1', 'busl-1.1'),
    ('Universal Permissive License', 'upl'),
    ('Universal Permissive License v1.0', 'upl-1.0'),
    ('Mulan Permissive Software License', 'mulanpsl'),
    ('Mulan Permissive Software License, v2', 'mulanpsl-2.0'),
    ('LaTeX Project Public License', 'lppl'),
    ('LaTeX Project Public License 1.3c', 'lppl-1.3c'),
    ('Blue Oak Model License', 'blueoak'),
    ('Blue Oak Model License 1.0.0', 'blueoak-1.0.0'),
    ('EUPL-1.2', 'eupl-1.2'),
    ('European Union Public License', 'eupl'),
    ('Eclipse Public License 1.0', 'epl-1.0'),
    ('EPL-2.0', 'epl-2.0'),
    ('Mozilla Public License', 'mpl'),
    ('MPL-1.1', 'mpl-1.1'),
    ('Mozilla Public License Version 1.1', 'mpl-1.1'),
    ('GNU Library General Public License version 2', 'lgpl-2.0'),
    ('Lesser General Public License', 'lgpl'),
    ('GNU LGPL', 'lgpl'),
    ('GNU GPL', 'gpl'),
    ('GNU AGPL', 'agpl'),
    ('GNU Free Documentation License', 'gfdl'),
    ('GFDL', 'gfdl'),
    ('GFDL 1.2', 'gfdl-1.2'),
    ('Artistic License 2.0', 'artistic-2.0'),
    ('Artistic-2.0', 'artistic-2.0'),
    ('PHP License, version 3.0', 'php-3.0'),
    ('Zope Public License 2.1', 'zpl-2.1'),
    ('Zope Public License', 'zpl'),
    ('Open Software License 3.0', 'osl-3.0'),
    ('Open Software License', 'osl'),
    ('Academic Free License', 'afl'),
    ('ISC License', 'isc'),
    ('BSD 3-Clause License', 'bsd-3-clause'),
    ('Simplified BSD License', 'bsd-2-clause'),
    ('BSD License', 'bsd'),
    ('zlib License', 'zlib'),
    ('The Unlicense', 'unlicense'),
    ('WTFPL', 'wtfpl'),
    ('released into the public domain', 'public-domain'),
    ('CC BY-NC 2.0', 'cc-by-nc-2.0'),
    ('CC BY-ND', 'cc-by-nd'),
    ('Creative Commons Attribution-NonCommercial-ShareAlike 3.0', 'cc-by-nc-sa-3.0'),
    ('Creative Commons Attribution', 'cc-by'),
    ('SPDX-License-Identifier: CC-BY-SA-2.5', 'cc-by-sa-2.5'),
    ('SPDX-License-Identifier: MIT', 'mit'),
    ('SPDX-License-Identifier: LGPL-2.0-or-later', 'lgpl-2.0'),
    ('https://www.gnu.org/licenses/agpl-3.0.txt', 'agpl-3.0'),
    ('https://www.gnu.org/licenses/fdl-1.3.html', 'gfdl-1.3'),
    ('https://opensource.org/licenses/MIT', 'mit'),
    ('https://www.apache.org/licenses/LICENSE-2.0', 'apache-2.0'),
    ('https://www.mozilla.org/MPL/2.0/', 'mpl-2.0'),
    ('https://www.eclipse.org/legal/epl-v10.html', 'epl-1.0'),
    ('GNU General Public License, version 1', 'gpl-1.0'),
    ('GNU General Public License version 4', 'gpl'),
    ('GPL v2.0', 'gpl-2.0'),
    ('Mozilla Public License 3.0', 'mpl'),
    ('Apache-2.0', 'apache-2.0'),
    ('ASL 2.0', 'apache-2.0'),
    ('Apache 1.1', 'apache-1.1'),
    ('License: GPL-3.0+', 'gpl-3.0'),
    ("license: 'ISC'", 'isc'),
]


def test_labels_state_no_version_that_the_text_does_not(spark):
    docs = spark.createDataFrame([(i, f"Some words.\n{t}\nMore words.") for i, (t, _) in enumerate(NAMES)], "doc_id long, text string")
    found = {}
    for r in L.detections(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.label)
    wrong = {t: found.get(i, set()) for i, (t, label) in enumerate(NAMES) if found.get(i, set()) != ({label} if label else set())}
    assert not wrong and len(NAMES) > 100


def test_notices_without_a_version(spark):
    notices = [
        ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version", "gfdl-1.2"),
        ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "gfdl"),
        ("The contents of this file are subject to the terms of the Common Development and Distribution License (the License)", "cddl"),
        ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "lgpl-2.1"),
        ("under the terms of the GNU Library General Public License as published by the Free Software Foundation; version 2", "lgpl-2.0"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License", "gpl-3.0"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(notices)], "doc_id long, text string")
    found = sorted((r.doc_id, r.label) for r in L.detections(docs).collect())
    assert found == [(i, label) for i, (_, label) in enumerate(notices)]
