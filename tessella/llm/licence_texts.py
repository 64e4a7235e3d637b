"""How works name their licences. Names and passages train the classifier; templates confirm what it finds."""

from __future__ import annotations

#: The names of each family of licences, as notices and package files write them.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU AGPL version 3", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache-2.0", "Apache License 2.0", "Apache Software License", "Apache 2.0 license", "ASL 2.0"],
    "Artistic": ["Artistic License 2.0", "Artistic-2.0", "Artistic License", "Perl Artistic License"],
    "BSD": ["BSD license", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license", "2-clause BSD license", "New BSD License", "Simplified BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "BSL-1.0", "Boost Software License"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivs License"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "CC0": ["CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "CC0 public domain dedication"],
    "CDDL": ["Common Development and Distribution License", "CDDL-1.0", "CDDL 1.1"],
    "EPL": ["Eclipse Public License", "EPL-2.0", "EPL-1.0", "Eclipse Public License 2.0"],
    "EUPL": ["European Union Public Licence", "EUPL-1.2", "European Union Public License 1.2"],
    "GFDL": ["GNU Free Documentation License", "GFDL-1.3", "GFDL-1.2-or-later"],
    "GPL-2.0": ["GNU General Public License version 2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3", "GNU GPL v3", "GNU General Public License"],
    "ISC": ["ISC License", "ISC licence", "ISC"],
    "LGPL": ["GNU Lesser General Public License", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "LGPLv3", "GNU Library General Public License"],
    "MIT": ["MIT License", "MIT", "MIT licence", "Expat License", "MIT/X11 license"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "MPL-2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "OFL": ["SIL Open Font License, Version 1.1", "OFL-1.1", "SIL Open Font License"],
    "PSF": ["Python Software Foundation License", "PSF-2.0", "PSF license agreement", "Python-2.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License", "Zlib", "zlib/libpng license"],
}

#: Sentences that name a licence.
FRAMES = [
    "Licensed under the {}.",
    "Licensed under {}",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This project is licensed under a {} - see the LICENSE file for details.",
    "Distributed under the terms of the {}. See LICENSE for more information.",
    "You may use this software under the {} only.",
    "The source code is available under the {}",
    "License: {}",
    "SPDX-License-Identifier: {}",
    "Copyright (c) 2021 The Authors. Use of this source code is governed by the {}.",
    "All files in this repository fall under the {} unless stated otherwise.",
    "This data set is published under {}, so please keep this notice.",
    "Published by the authors under {} terms",
]

#: Passages of the licences and their notices.
PASSAGES = {
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source under the Affero license"],
    "Apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0"],
    "CDDL": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License)"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution"],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts"],
    "GPL-2.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, version 2"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "Permission is hereby granted, free of charge, to any person obtaining a copy", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "OFL": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at https://scripts.sil.org/OFL"],
    "PSF": ["This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization accessing and otherwise using this software in source or binary form"],
    "proprietary": ["Copyright (c) 2020 Example Corp. All rights reserved.", "All rights reserved.", "All Rights Reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "This software is proprietary and confidential; no part may be reproduced without prior written permission, all rights reserved", "(c) The Authors, all rights reserved worldwide"],
    "public-domain": ["This work is dedicated to the public domain.", "The author has placed this work in the public domain.", "This file is in the public domain and may be used freely", "Released into the public domain by its author", "I hereby release this code to the public domain"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, see unlicense.org"],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, you just do what the fuck you want to"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
}

#: Licences of no family here; words of the corpus give further ones.
OTHERS = ["license of this project", "Acme Software License", "Acme Corporation license 1.2", "company internal terms", "Community License Agreement", "Research Only License", "vendor license version 4", "Foo Public License", "license found in the file COPYING", "sample data license", "terms of use", "custom license 2.0"]

#: Sentences that name no licence, though they hold words of notices.
PROSE = [
    "The driver lost his license last year.", "She studies software at MIT in Cambridge.", "The Apache helicopter flew over the public road.",
    "All seats are reserved for members of the committee.", "The rights of all citizens were discussed.", "He asked for permission to use the library.",
    "A public hearing was granted to any person with documents.", "The source of the river is in the domain of the king.", "The software was released in version 2 last week.",
    "The new version is distributed free of charge in most towns.", "Copyright law is taught in the third year.", "The general public may obtain a copy at the desk.",
    "Creative people often work in the commons room.", "The fishing licence costs more this year.", "The warranty of the car ends in May.", "The mozilla browser and the eclipse were seen in version 1.0.",
    "This file is kept under the table.", "The terms of the sale are subject to change.", "You may use the door in the back.", "See the notice at the door for details.",
]

#: What a paragraph of each family holds; one of them, or nearly all of one, confirms it.
TEMPLATES = {
    "AGPL": ["affero general public license", "agpl 3 0", "agpl version 3", "agplv3", "affero license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0", "apache software license", "apache software foundation", "asl 2 0", "you may not use this file except in compliance with the license", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"],
    "Artistic": ["artistic license", "artistic 2 0"],
    "BSD": ["bsd license", "bsd 3 clause", "bsd 2 clause", "clause bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "may be used to endorse or promote products derived from this software"],
    "BSL-1.0": ["boost software license", "bsl 1 0"],
    "CC-BY": ["cc by 4 0", "cc by 3 0", "creative commons attribution license", "creative commons attribution 4 0", "creative commons attribution 3 0"],
    "CC-BY-NC": ["cc by nc 4 0", "cc by nc 3 0", "creative commons attribution noncommercial license", "creative commons attribution noncommercial 4 0"],
    "CC-BY-NC-ND": ["cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs"],
    "CC-BY-NC-SA": ["cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "CC-BY-ND": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"],
    "CC-BY-SA": ["cc by sa", "creative commons attribution sharealike"],
    "CC0": ["cc0 1 0", "creative commons zero", "cc0 public domain dedication", "waived all copyright and related or neighboring rights"],
    "CDDL": ["common development and distribution license", "cddl 1 0", "cddl 1 1"],
    "EPL": ["eclipse public license", "epl 2 0", "epl 1 0"],
    "EUPL": ["european union public licence", "european union public license", "eupl 1 2"],
    "GFDL": ["gnu free documentation license", "gfdl 1 3", "gfdl 1 2"],
    "GPL-2.0": ["gnu general public license version 2", "gpl 2 0", "gplv2", "gpl v2", "gnu general public license as published by the free software foundation either version 2", "gnu general public license along with this program if not write to the free software foundation"],
    "GPL-3.0": ["gnu general public license version 3", "gpl 3 0", "gplv3", "gpl v3", "gnu general public license"],
    "ISC": ["isc license", "isc licence", "spdx license identifier isc", "license isc", "under isc", "the isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy modify and distribute this software for any purpose with or without fee"],
    "LGPL": ["gnu lesser general public license", "gnu library general public license", "lgpl 2 1", "lgpl 3 0", "lgplv3"],
    "MIT": ["mit license", "mit licence", "expat license", "mit x11", "spdx license identifier mit", "license mit", "under mit", "the mit", "permission is hereby granted free of charge to any person obtaining a copy", "copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "rights to use copy modify merge publish distribute sublicense and or sell copies"],
    "MPL-2.0": ["mozilla public license", "mpl 2 0"],
    "OFL": ["sil open font license", "ofl 1 1"],
    "PSF": ["python software foundation", "psf 2 0", "psf license agreement", "python 2 0"],
    "proprietary": ["all rights reserved", "proprietary and confidential"],
    "public-domain": ["dedicated to the public domain", "in the public domain", "into the public domain", "to the public domain"],
    "Unlicense": ["the unlicense", "unlicense", "free and unencumbered software", "see unlicense org"],
    "WTFPL": ["wtfpl", "do what the fuck you want to"],
    "Zlib": ["zlib license", "zlib", "provided as is without any express or implied warranty in no event will the authors be held liable", "altered source versions must be plainly marked"],
}
