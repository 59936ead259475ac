"""The wording of public licences. Notices are one sentence or paragraph; titles open a licence file;
texts are whole headers and whole short licences."""

# Fixed values from here on.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["All rights reserved."],
}
TITLES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007"],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "MIT": ["The MIT License (MIT)", "MIT License"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}
_NO_WARRANTY = (
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not "
    "limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright "
    "holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not "
    "limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any "
    "theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of "
    "this software, even if advised of the possibility of such damage."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_THIRD_CLAUSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_WITHOUT_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General "
    "Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
TEXTS = {
    "Apache-2.0": [
        NOTICES["Apache-2.0"][2] + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["Copyright (c) All rights reserved. " + _TWO_CLAUSES + _NO_WARRANTY],
    "BSD-3-Clause": ["Copyright (c) All rights reserved. " + _TWO_CLAUSES + _THIRD_CLAUSE + _NO_WARRANTY],
    "GPL-2.0": [NOTICES["GPL-2.0"][0] + " " + _WITHOUT_WARRANTY],
    "GPL-3.0": [NOTICES["GPL-3.0"][2] + " " + _WITHOUT_WARRANTY],
    "ISC": [
        "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided \"as is\" and "
        "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no "
        "event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from "
        "loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with "
        "the use or performance of this software.",
    ],
    "MIT": [
        "MIT License Copyright (c) " + NOTICES["MIT"][2] + " The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. The software is provided \"as is\", without warranty of any kind, express or implied, including but "
        "not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or "
        "copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, "
        "out of or in connection with the software or the use or other dealings in the software.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. For more information, please refer to <https://unlicense.org/>",
    ],
}
